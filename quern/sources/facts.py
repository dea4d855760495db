"""Readers of the fact producer's JSON and of what surrounds it, into long tables.

Readers take schemas, never infer them; bad records stay in ``_corrupt_record``.  Missing,
null and empty lists are one: children simply have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_POINT = "STRUCT<line:INT, type:STRING, category:STRING, pattern:STRING>"
_SIZE = "STRUCT<line:INT, type:STRING, var:STRING, pattern:STRING>"
_ARG = "STRUCT<index:INT, roots:ARRAY<STRING>>"
_CALL = f"STRUCT<line:INT, name:STRING, pkg:STRING, recv:STRING, nargs:INT, args:ARRAY<{_ARG}>>"
_TEXT = "STRUCT<line:INT, text:STRING>"

#: The producer's output for one package directory.
ANALYSIS = f"""
repo STRING, snapshot STRING, dir STRING, parse_mode STRING,
functions ARRAY<STRUCT<file:STRING, name:STRING, receiver:STRING, line:INT, calls:ARRAY<STRING>>>,
imports MAP<STRING, STRUCT<stdlib:ARRAY<STRING>, third_party:ARRAY<STRING>, stdlib_markers:ARRAY<STRING>>>,
call_chains ARRAY<STRUCT<root_file:STRING, root_function:STRING, calls:ARRAY<STRUCT<callee:STRING, depth:INT, type:STRING, package:STRING>>>>,
data_flow_indicators ARRAY<STRUCT<file:STRING, function:STRING, sources:ARRAY<{_POINT}>, sinks:ARRAY<{_POINT}>, sanitizers:ARRAY<{_POINT}>>>,
stdlib_signals ARRAY<STRUCT<package:STRING, apis:ARRAY<STRING>, domain_hints:ARRAY<STRING>>>,
concurrency_patterns ARRAY<STRUCT<file:STRING, function:STRING, line:INT, type:STRING, code:STRING>>,
size_flows ARRAY<STRUCT<file:STRING, function:STRING, size_sinks:ARRAY<{_SIZE}>, range_checks:ARRAY<{_SIZE}>>>,
param_flows ARRAY<STRUCT<file:STRING, function:STRING, line:INT, end_line:INT, recv_type:STRING, variadic:BOOLEAN, handler:BOOLEAN, principal_check:BOOLEAN,
    results:ARRAY<STRING>, return_roots:ARRAY<STRING>, ret_params:ARRAY<INT>, check_lines:ARRAY<INT>,
    params:ARRAY<STRUCT<index:INT, name:STRING, type:STRING, first_use:INT, type_pkg:STRING, type_base:STRING>>,
    call_sites:ARRAY<{_CALL}>, ret_calls:ARRAY<{_CALL}>, callees:ARRAY<{_CALL}>, callback_refs:ARRAY<{_CALL}>,
    taint_sinks:ARRAY<STRUCT<line:INT, type:STRING, pattern:STRING, roots:ARRAY<STRING>>>,
    check_facts:ARRAY<{_TEXT}>, resource_access:ARRAY<{_TEXT}>, sanitizers:ARRAY<STRUCT<line:INT, category:STRING>>>>,
wire_types ARRAY<STRUCT<file:STRING, name:STRING>>,
_corrupt_record STRING
"""

#: The producer's index of a snapshot: spans of functions, uses of fields, assignments, and what it left out.
SOURCE_INDEX = """
repo STRING, snapshot STRING,
spans ARRAY<STRUCT<path:STRING, name:STRING, kind:STRING, line:INT, end_line:INT, signature:STRING>>,
field_uses ARRAY<STRUCT<path:STRING, name:STRING, kind:STRING, line:INT, offset:INT, expression:STRING, type_id:STRING, scope_start:INT, binding_id:INT>>,
assignments ARRAY<STRUCT<path:STRING, name:STRING, line:INT, offset:INT, scope_start:INT, binding_id:INT, expression:STRING>>,
excluded ARRAY<STRING>, errors ARRAY<STRING>, _corrupt_record STRING
"""

#: Reports of old and new shape; fields that a shape lacks are null.
REPORT = """
scan_info STRUCT<project:STRING, timestamp:STRING>,
findings ARRAY<STRUCT<function:STRING, template_id:STRING, pattern_name:STRING, missing_step_category:STRING, reasoning:STRING, evidence:STRING,
    severity:STRING, confidence:DOUBLE, rule_id:STRING, cvss_score:DOUBLE, cwe_alignment:ARRAY<STRING>,
    span:STRUCT<source:STRUCT<line:INT, type:STRING, desc:STRING>, sink:STRUCT<line:INT, type:STRING, desc:STRING>>>>
"""


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents (or JSON lines) with a fixed schema; bad ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def package_folders(paths: DataFrame, path: str, max_depth: int | None = 4) -> DataFrame:
    """Folders that hold Go files, pruned of vendored, test-data and hidden ones, down to a depth."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*\.go$", 1)
    pruned = r"(^|/)(vendor|testdata|node_modules|\.git)(/|$)"
    found = paths.where(F.col(path).rlike(r"\.go$") & ~F.col(path).rlike(r"_test\.go$")).select(folder.alias("folder")).distinct().where(~F.col("folder").rlike(pruned))
    return found if max_depth is None else found.where(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))) <= max_depth)


def _prefixed(file: Column) -> Column:
    return F.concat_ws("/", F.when(F.coalesce("dir", F.lit("")) != "", F.col("dir")), file)


def _key(x: Column) -> Column:
    return F.concat_ws(":", _prefixed(x["file"]), x["function"])


def merged_tables(analysis: DataFrame) -> dict[str, DataFrame]:
    """Long tables of all packages of all repositories; paths carry their folder, chains and signals once each."""
    head = ["repo", "snapshot"]

    def rows(column: str) -> DataFrame:
        return analysis.select(*head, "dir", F.posexplode(column).alias("ord", "x"))

    x = F.col("x")
    functions = rows("functions").select(*head, _prefixed(x["file"]).alias("file"), x["name"].alias("name"), x["receiver"].alias("receiver"), x["line"].alias("line"), x["calls"].alias("calls"))
    imports = analysis.select(*head, "dir", F.explode("imports").alias("file", "x")).select(*head, _prefixed(F.col("file")).alias("file"), "x.*")
    chains = rows("call_chains").select(*head, "ord", _prefixed(x["root_file"]).alias("root_file"), x["root_function"].alias("root_function"), x["calls"].alias("calls")).dropDuplicates([*head, "root_file", "root_function"])
    flows = rows("data_flow_indicators").select(*head, _key(x).alias("function"), F.explode(F.array(
        F.struct(F.lit("source").alias("kind"), x["sources"].alias("points")), F.struct(F.lit("sink").alias("kind"), x["sinks"].alias("points")), F.struct(F.lit("sanitizer").alias("kind"), x["sanitizers"].alias("points")))).alias("side"))
    points = flows.select(*head, "function", "side.kind", F.posexplode("side.points").alias("ord", "p")).select(*head, "function", "kind", "ord", "p.*")
    sizes = rows("size_flows").select(*head, _key(x).alias("function"), x["size_sinks"].alias("sinks"), x["range_checks"].alias("checks"))
    flat = lambda df, c: df.select(*head, "function", F.explode(c).alias("p")).select(*head, "function", "p.*")
    params = rows("param_flows").select(*head, F.struct(_prefixed(x["file"]).alias("file"), *[x[f].alias(f) for f in (
        "function", "line", "end_line", "recv_type", "variadic", "handler", "principal_check", "results", "return_roots", "ret_params", "check_lines", "params",
        "call_sites", "ret_calls", "callees", "callback_refs", "taint_sinks", "check_facts", "resource_access", "sanitizers")]).alias("f")).select(*head, "f.*")
    keyed = params.withColumn("fid", F.concat_ws(":", "file", "function"))
    child = lambda c: keyed.select(*head, F.col("fid").alias("function"), F.explode(c).alias("p")).select(*head, "function", "p.*")
    return {
        "functions": functions, "imports": imports, "call_chains": chains.drop("ord"), "flow_points": points,
        "signals": rows("stdlib_signals").select(*head, "x.*").dropDuplicates([*head, "package"]),
        "concurrency": rows("concurrency_patterns").select(*head, _key(x).alias("function"), "x.line", "x.type", "x.code"),
        "size_sinks": flat(sizes, "sinks"), "range_checks": flat(sizes, "checks"), "param_flows": params,
        "call_sites": child("call_sites"), "taint_sinks": child("taint_sinks"), "check_facts": child("check_facts"),
        "check_lines": keyed.select(*head, F.col("fid").alias("function"), F.explode("check_lines").alias("line")),
        "sanitizers": child("sanitizers"),
        "wire_types": rows("wire_types").select(*head, F.regexp_extract(_prefixed(x["file"]), r"^(.*)/", 1).alias("dir"), x["name"].alias("name")).distinct(),
        "unavailable": analysis.where("functions is null").select(*head, "dir"),
    }


def index_tables(index: DataFrame) -> dict[str, DataFrame]:
    """spans, field_uses and assignments as rows; excluded files and errors with their repository."""
    head = ["repo", "snapshot"]
    rows = lambda c: index.select(*head, F.explode(c).alias("x")).select(*head, "x.*")
    texts = lambda c: index.select(*head, F.explode(c).alias("text"))
    return {c: rows(c) for c in ("spans", "field_uses", "assignments")} | {c: texts(c) for c in ("excluded", "errors")}


def modules_of(texts: DataFrame) -> DataFrame:
    """repo, module, rel_dir and place (from 1 in a repository: longest module first) of go.mod files (path, text)."""
    found = texts.select("repo", F.regexp_extract("text", r"(?m)^module\s+\"?([^\s\"]+)", 1).alias("module"), F.regexp_extract("path", r"^(.*)/go\.mod$", 1).alias("rel_dir"))
    order = Window.partitionBy("repo").orderBy(F.length("module").desc(), "module", "rel_dir")
    return found.where("module <> ''").withColumn("place", F.row_number().over(order))


def findings_of(reports: DataFrame) -> DataFrame:
    """project and finding columns, of either shape."""
    return reports.select("scan_info.project", F.posexplode("findings").alias("ord", "f")).select("project", "ord", "f.*")


def advisory_of(html: Column) -> dict[str, Column]:
    """Fields of an advisory page: id, aliases, description, references."""
    once = lambda p: F.regexp_extract(html, p, 1)
    return {
        "go_id": once(r"\b(GO-\d{4}-\d{4,})\b"), "aliases": F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"\b(CVE-\d{4}-\d{4,}|GHSA(?:-[a-z0-9]{4}){3})\b"), F.lit(1)))),
        "description": F.trim(F.regexp_replace(once(r"(?s)<h2>Description</h2>\s*<p>(.*?)</p>"), r"<[^>]+>", "")),
        "references": F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="(https?://[^"]+)"'), F.lit(1))),
    }

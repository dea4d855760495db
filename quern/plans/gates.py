"""Gates, filters, caps and look-ups around the rules.

Defined cases: a null name, path or key passes no gate that asks for one and meets no row; a missing severity is
low; what a cap leaves out is told by ``truncated``; of ties the order given by the caller holds, so it should be
total; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalars
from quern.operators import aggregates, matching
from quern.plans import seeds

#: Severities in order, from the worst.
SEVERITIES = ("critical", "high", "medium", "low", "none")
#: Folders of helpers for tests and of examples, names of helper files, names that tell nothing.
TEST_FOLDERS = (
    "testing", "testutil", "testutils", "testhelper", "testhelpers", "test", "tests", "e2e", "integration", "mock", "mocks", "fake", "fakes",
    "fixtures", "testdata", "examples", "example",
)
TEST_FILE = r"(_test\.go$)|(^.*_mock.*\.go$)|(^mock_.*\.go$)|(^.*_fake.*\.go$)"
NOISE = (
    "fmt.Errorf", "fmt.Sprintf", "errors.New", "fmt.Println", "fmt.Print", "fmt.Fprintln", "log.Printf", "log.Println", "log.Print", "errors.Is",
    "errors.As", "context.Background", "time.Now", "context.WithValue", "testing.T", "make", "new", "append", "len", "cap", "panic", "unsafe.Pointer",
)
#: Words that tell of HTTP, and receivers that mark test scaffolding.
HTTP_WORDS = (
    "http.handler", "http.handlerfunc", "http.request", "gin.context", "echo.context", "httptest", "servehttp", "handler", "router", "net/http",
    "http.handle",
)
TEST_RECEIVERS = ("t", "assert", "require", "gomock", "ctrl", "tester", "test", "mock", "mocks", "suite", "b", "tb")


def focused(functions: DataFrame, names: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """Functions of the given names and files; no list, no restriction."""
    out = functions if not names else functions.where(F.col("name").isin(*names) | scalars.qualified(F.col("receiver"), F.col("name")).isin(*names))
    return out if not files else out.where(F.col("file").isin(*files))


def with_flow(functions: DataFrame, flow_points: DataFrame) -> DataFrame:
    """Functions with a source or a sink."""
    return functions.join(flow_points.where("kind in ('source', 'sink')").select("function").distinct(), "function", "left_semi")


def taint_gate(functions: DataFrame, facts: DataFrame, size_sinks: DataFrame, flow_points: DataFrame, entries: DataFrame, level: str, drop_generic: bool) -> DataFrame:
    """Functions worth a costly look.

    A: a structural fact, a size sink with a source, or a source with a sink to pair; B: also any sink
    to pair; C: also any source.  Entries by triage always pass.
    """
    if level not in ("A", "B", "C"):
        raise ValueError(f"unknown level: {level}")
    sinks = flow_points.where("kind = 'sink'")
    pairable = (sinks.where(~F.col("type").isin(*seeds.GENERIC_SINKS)) if drop_generic else sinks).select("function")
    sources = flow_points.where("kind = 'source'").select("function")
    both = lambda a, b: a.select("function").join(b.select("function").distinct(), "function", "left_semi")
    admitted = facts.select("function").union(both(size_sinks, sources)).union(both(sources, pairable)).union(entries.select("function"))
    if level in "BC":
        admitted = admitted.union(pairable)
    if level == "C":
        admitted = admitted.union(sources)
    return functions.join(admitted.distinct(), "function", "left_semi")


def at_least(severity: Column, floor: str) -> Column:
    """Is a severity the floor or worse? A missing one is low, an unknown one none."""
    if floor == SEVERITIES[-1]:
        return F.lit(True)
    return F.coalesce(severity, F.lit("low")).isin(*SEVERITIES[: SEVERITIES.index(floor) + 1])


def filtered_findings(findings: DataFrame, categories: list[str] | None = None, floor: str = "none", least_confidence: float = 0.0, statuses: list[str] | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Findings of some categories, severities, confidence and validation statuses; of those the first ``limit`` by ``order``."""
    out = findings.where(at_least(F.col("severity"), floor) & (F.col("confidence") >= least_confidence))
    out = out.where(F.col("category").isin(*categories)) if categories else out
    out = out.where(F.col("validation_status").isin(*statuses)) if statuses else out
    return out.orderBy(*(order or [])).limit(limit) if limit else out


def is_test_path(path: Column) -> Column:
    """A file in a folder of test helpers or examples, or of a helper's name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*TEST_FOLDERS)) | F.element_at(parts, -1).rlike(TEST_FILE)


def mined(counted: DataFrame, files: int, noise: tuple[str, ...] = NOISE, least: int = 2, widest: float = 0.15) -> DataFrame:
    """Mined names that are neither noise nor rare nor all over: value, total, n_files."""
    return counted.where(~F.col("value").isin(*noise) & (F.col("total") >= least) & (F.col("n_files") <= F.floor(F.lit(files * widest))))


def call_bucket(call: Column, standard: Column) -> Column:
    """stdlib or framework; null for noise and test scaffolding. ``standard``: is the first part a standard package?"""
    noise = call.isin(*NOISE) | F.substring_index(call, ".", 1).isin(*TEST_RECEIVERS)
    return F.when(~noise, F.when(standard, "stdlib").otherwise("framework"))


def sensitive_signals(imports: DataFrame, dimension: DataFrame) -> DataFrame:
    """package, apis, domain_hints of the standard packages that a repository imports, by name."""
    used = imports.select("repo", F.explode("stdlib").alias("package")).distinct()
    return used.join(matching.bounded(dimension), "package")


def split_imports(imports: DataFrame) -> DataFrame:
    """repo, file, path, standard, alias of each import."""
    each = imports.select("repo", "file", F.explode("paths").alias("path"))
    return each.withColumns({"standard": scalars.is_standard_package(F.col("path")), "alias": scalars.alias_of(F.col("path"))})


def domains(recorded: DataFrame, signals: DataFrame) -> DataFrame:
    """Recorded domains (domain, confidence), else those inferred from the hints of imported packages."""
    if not recorded.isEmpty():
        return recorded.select("domain", "confidence")
    return aggregates.shares(signals.select(F.explode("domain_hints").alias("domain")), "domain").select("domain", "confidence")


def prioritised(functions: DataFrame, flow_points: DataFrame, calls: DataFrame, imports: DataFrame, apis: DataFrame) -> DataFrame:
    """Functions with a score above zero: score and reasons.

    ``functions``: function, file, name; ``calls``: function, callee; ``imports``: file, stdlib; ``apis``: api.
    A sink alone scores 1, and 10 more if it is a dangerous one; with a source, 3 in all.
    """
    flow = flow_points.groupBy("function").agg(
        F.bool_or(F.col("kind") == "source").alias("src"), F.bool_or(F.col("kind") == "sink").alias("snk"),
        F.bool_or((F.col("kind") == "sink") & F.col("type").isin(*seeds.DANGEROUS_SINKS)).alias("danger"))
    matched = matching.matching_calls(calls, apis, ["function"], "callee", "api")
    http = calls.groupBy("function").agg(F.bool_or(F.contains(F.lower("callee"), F.lit("http")) | F.contains("callee", F.lit("Handle"))).alias("http"))
    risky = imports.select("file", F.arrays_overlap("stdlib", F.array(*map(F.lit, seeds.RISKY_PACKAGES))).alias("risky"))
    j = functions.join(flow, "function", "left").join(matched, "function", "left").join(http, "function", "left").join(risky, "file", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    pair, alone = yes("src") & yes("snk"), yes("src") | yes("snk")
    named = F.exists(F.array(*map(F.lit, seeds.RISKY_NAMES)), lambda w: F.contains(F.lower("name"), w))
    terms = [
        (F.when(pair, 3).when(alone, 1 + F.when(yes("danger"), 10).otherwise(0)), F.when(pair, "source and sink").when(yes("danger"), "dangerous sink").when(alone, "source or sink")),
        (2 * F.col("matching"), F.when(F.col("matching") > 0, "matching API")), (F.when(yes("http"), 2), F.when(yes("http"), "HTTP handler")),
        (F.when(yes("risky"), 2), F.when(yes("risky"), "risky package")), (F.when(named, 1), F.when(named, "name")),
    ]
    score = sum((F.coalesce(s, F.lit(0)) for s, _ in terms), F.lit(0))
    out = j.withColumns({"score": score.cast("int"), "reasons": F.array_compact(F.array(*[r for _, r in terms]))})
    return out.where("score > 0").select(*functions.columns, "score", "reasons")


def with_facts(scored: DataFrame, functions: DataFrame, facts: DataFrame, score: int = 15) -> DataFrame:
    """Scored functions, and those with structural facts that aren't among them, at a fixed score."""
    more = functions.join(facts.select("function").distinct(), "function", "left_semi").join(scored.select("function"), "function", "left_anti")
    return scored.unionByName(more.select(*[c for c in scored.columns if c not in ("score", "reasons")], F.lit(score).alias("score"), F.array(F.lit("structural fact")).alias("reasons")))


def first_n(functions: DataFrame, n: int, entries: DataFrame | None = None) -> DataFrame:
    """The ``n`` first functions of each repository: entries first (if given), else by score; then by key. Filter before."""
    if entries is not None:
        tagged = functions.join(entries.select("function", F.lit(True).alias("entry")), "function", "left")
        return aggregates.best_of_each(tagged, ["repo"], [F.col("entry").isNull(), F.col("function")], n).drop("entry")
    return aggregates.best_of_each(functions, ["repo"], [F.desc("score"), F.col("function")], n)


def neighbours(edges: DataFrame, key: str, other: str, order: list[str], cap: int = 100) -> DataFrame:
    """The first ``cap`` edges of each ``key``, with n (all of them) and truncated: a report's bounded view."""
    by = Window.partitionBy(key)
    ranked = edges.withColumns({"place": F.row_number().over(by.orderBy(other, *order)), "n": F.count("*").over(by)})
    return ranked.where(F.col("place") <= cap).withColumn("truncated", F.col("n") > cap)


def callers_in_text(lines: DataFrame, names: DataFrame, cap: int = 12) -> DataFrame:
    """name, file, n, line, truncated: up to ``cap`` places where a name is called, outside tests, vendored code and declarations.

    Lines are split into the words before a parenthesis, which meet names by equality.  ``truncated``
    tells whether there are more places.
    """
    called = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    words = lines.where(~is_test_path(F.col("file")) & ~F.col("file").rlike(r"(^|/)vendor/") & ~F.col("line").rlike(r"^\s*func\b")).select("file", "n", "line", F.explode(called).alias("name"))
    by = Window.partitionBy("name")
    met = words.join(names.select("name").distinct(), "name").withColumns({"__place": F.row_number().over(by.orderBy("file", "n")), "truncated": F.count("*").over(by) > cap})
    return met.where(F.col("__place") <= cap).drop("__place")


def batches(work: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """Work items with batch: ``size`` at a time, in order."""
    return work.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))


def mapped_ids(keys: DataFrame, functions: DataFrame) -> DataFrame:
    """Keys with function_id where exactly one function has the key, else null and ambiguous."""
    counted = functions.groupBy("function").agg(F.count("*").alias("n"), F.min("function_id").alias("id"))
    j = keys.join(counted, "function", "left")
    return j.select(*keys.columns, F.when(F.col("n") == 1, F.col("id")).alias("function_id"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def about_http(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, HTTP_WORDS)), lambda w: F.contains(F.lower(text), w))


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, and tokens in and out, of recorded model calls."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def advisories_with_commits(advisories: DataFrame, commits: DataFrame) -> DataFrame:
    """Advisories with the last commit of their repository, named in any case; and repositories only commits name.

    ``advisories``: go_id, repo, ...; ``commits``: repo, commit, ord.
    """
    last = commits.groupBy(F.lower("repo").alias("__repo")).agg(F.max_by("commit", "ord").alias("commit"))
    joined = advisories.withColumn("__repo", F.lower("repo")).join(last, "__repo", "full")
    return joined.select(F.col("go_id"), F.coalesce("repo", "__repo").alias("repo"), "commit")


def validation_summary(advisories: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per advisory: findings in its functions, their categories, and verdicts of their units.

    ``advisories``: go_id, functions (array); ``findings``: function, category, unit_id; ``verdicts``: unit_id, verdict.
    """
    targets = advisories.select("go_id", F.explode_outer("functions").alias("function"))
    j = targets.join(findings.select("function", "category", "unit_id"), "function", "left").join(verdicts.select("unit_id", "verdict"), "unit_id", "left")
    return j.groupBy("go_id").agg(F.count("category").alias("findings"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("verdict")).alias("verdicts"))

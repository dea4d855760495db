"""Queries of prepared records, facts from rows of calls, and reports, each with its SQL.

As in ``queries``, a customer or an order stands for a function, a call or a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import texts
from quern.plans import binding, gates, judge, prepare, producer, reports
from quern.plans.queries import query, table


def _case(key: Column, values: list, default=None) -> Column:
    out = F.lit(default)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(key == i, v).otherwise(out)
    return out


def _text_of(c: Column) -> Column:
    return c.cast("string")


# -- prepared records -------------------------------------------------------------------------------

def _patches(spark, directory) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files and hunks of customers' patches, and the lines of their files before.

    Even customers change z.go before a.go, odd ones after; every fourth changes the mode of m.go, every third a test.
    """
    k = F.col("c_custkey")
    c = table(spark, directory, "customer").select("c_custkey", "c_nationkey")
    head = lambda f: f"diff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}\n"
    header = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("func (r *R) F"), k % 2, F.lit("() {")))
    a = F.concat(F.lit(head("a.go") + "@@ -2 +2 @@ "), header, F.lit("\n+x\n@@ -9 +9 @@ var y\n+y\n"))
    z = F.lit(head("z.go") + "@@ -2 +2 @@ type Z struct {\n+z\n")
    mode = F.when(k % 4 == 0, "diff --git a/m.go b/m.go\nold mode 100644\nnew mode 100755\n").otherwise("")
    test = F.when(k % 3 == 0, head("x_test.go") + "@@ -1 +1 @@ func TestA() {\n+++ b/odd.go\n").otherwise("")
    diff = texts.lines_of(c.select("c_custkey", F.concat(test, F.when(k % 2 == 0, F.concat(z, mode, a)).otherwise(F.concat(a, mode, z))).alias("text")), ["c_custkey"])
    sources = F.array(
        F.struct(F.lit("a.go").alias("file"), F.concat(F.lit("package p\nfunc F"), k % 3, F.lit("(x int) {\n  return "), "c_nationkey", F.lit("\n}\n\n")).alias("text")),
        F.struct(F.lit("z.go").alias("file"), F.concat(F.lit("package p\ntype Z struct {\n  f "), "c_nationkey", F.lit("\n}\n")).alias("text")))
    lines = texts.lines_of(c.select("c_custkey", F.explode(sources).alias("s")).select("c_custkey", "s.file", "s.text"), ["c_custkey", "file"])
    return texts.diff_files(diff, ["c_custkey"]), texts.diff_hunks(diff, ["c_custkey"]), lines


_CONTEXTS_SQL = """
P AS (SELECT c_custkey, concat('func (r *R) F', c_custkey % 2, '() {') AS function,
  concat(CASE WHEN c_custkey % 3 <> c_custkey % 2 THEN concat('package p', chr(10)) ELSE '' END, 'func F', c_custkey % 3, '(x int) {', chr(10), '  return ', c_nationkey, chr(10), '}') AS source_context
  FROM customer WHERE c_custkey % 5 <> 0),
Z AS (SELECT c_custkey, concat('type Z struct {', chr(10), '  f ', c_nationkey, chr(10), '}') AS z FROM customer)"""


@query(f"WITH {_CONTEXTS_SQL} SELECT c_custkey, 'a.go' AS file, function, source_context FROM P UNION ALL SELECT c_custkey, 'z.go', 'type Z struct {{', z FROM Z")
def source_contexts(spark, directory):
    """What patches change, with its source from where it is defined, else around the hunk."""
    _, hunks, lines = _patches(spark, directory)
    return prepare.contexts(hunks, lines, ["c_custkey"]).select("c_custkey", "file", "function", "source_context")


@query(f"""WITH {_CONTEXTS_SQL}, R AS (SELECT c_custkey, c_name, c_custkey % 2 = 0 AS even, CASE WHEN c_custkey % 4 = 0 THEN ['m.go'] ELSE [] END AS mode, ['type Z struct {{'] AS zf, [z] AS zc,
  CASE WHEN function IS NULL THEN ['var y'] ELSE [function, 'var y'] END AS af, CASE WHEN function IS NULL THEN [] ELSE [source_context] END AS ac FROM customer JOIN Z USING (c_custkey) LEFT JOIN P USING (c_custkey))
SELECT c_custkey, c_name, CASE WHEN even THEN ['z.go'] || mode || ['a.go'] ELSE ['a.go'] || mode || ['z.go'] END AS changed_files,
CASE WHEN even THEN zf || af ELSE af || zf END AS functions, CASE WHEN even THEN zc || ac ELSE ac || zc END AS contexts FROM R""")
def prepared_records(spark, directory):
    """M6: advisories with the files and functions that their patch changes, and the contexts of these, in its order."""
    files, hunks, lines = _patches(spark, directory)
    advisories = table(spark, directory, "customer").select("c_custkey", "c_name")
    out = prepare.records(advisories, files, hunks, prepare.contexts(hunks, lines, ["c_custkey"]), "c_custkey")
    return out.select("c_custkey", "c_name", "changed_files", F.col("changed_functions.function").alias("functions"), F.col("func_source_contexts.source_context").alias("contexts"))


# -- facts from rows of calls -----------------------------------------------------------------------

@query("""WITH O AS (SELECT CAST(o_custkey AS VARCHAR) AS function, o_custkey % 3 AS f, o_orderkey % 4 AS p, o_orderstatus AS s FROM orders)
SELECT DISTINCT function, CASE p WHEN 0 THEN 'run' WHEN 1 THEN concat('os.Do', s) WHEN 2 THEN concat('x.Do', s) ELSE concat('ext.Do', s) END AS callee,
  CASE WHEN p = 0 THEN 'local' WHEN p = 1 AND f <> 2 THEN 'stdlib' WHEN p = 3 AND f <> 1 THEN 'third_party' ELSE 'method' END AS type,
  CASE WHEN p = 1 AND f <> 2 THEN 'os' WHEN p = 3 AND f <> 1 THEN 'github.com/a/ext' ELSE '' END AS package
FROM O WHERE NOT (p = 0 AND s = 'O')""")
def call_types(spark, directory):
    """Callees of functions, once each, by what their prefix names in the file; builtins aren't calls."""
    p, n = F.col("o_orderkey") % 4, F.col("n_nationkey")
    name = F.when(p != 0, F.concat(F.lit("Do"), "o_orderstatus")).when(F.col("o_orderstatus") == "O", "make").otherwise("run")
    calls = table(spark, directory, "orders").select(F.col("o_custkey").cast("string").alias("function"), F.concat(F.lit("f"), F.col("o_custkey") % 3).alias("file"), F.col("o_orderkey").alias("ord"), _case(p, [F.lit(None), "os", "x"], "ext").alias("prefix"), name.alias("name"))
    nations = table(spark, directory, "nation").select(n, F.concat(F.lit("f"), n % 3).alias("file"))
    imported = lambda alias, path, but: nations.where(n % 3 != but).select("file", F.lit(alias).alias("alias"), F.lit(path).alias("path"))
    return producer.call_types(calls, imported("os", "os", 2).unionByName(imported("ext", "github.com/a/ext", 1)))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'src' WHEN 2 THEN 'io' WHEN 6 THEN 'io' ELSE '' END AS class, p_partkey % 4 < 2 AS outbound FROM part""")
def source_classes(spark, directory):
    """Classes of calls as sources, and whether they ask a remote side."""
    k = F.col("p_partkey")
    code = _case(k % 7, ['r.FormValue("a")', "l.Accept()", "os.ReadFile(p)", "bufio.NewReader(os.Stdin)", F.lit(None), "x.Body", "bufio.NewReader(f)"])
    patterns = [(".Body", "http_body"), ("Accept(", "network_accept"), ("os.ReadFile(", "read"), ("bufio.NewReader(", "buffered_read")]
    args = F.when(k % 7 == 3, F.array(F.lit("os.Stdin"))).otherwise(F.array(F.lit("f")))
    outbound = producer.is_outbound(_case(k % 4, ["http", "apiClient", "cache"]), _case(k % 4, ["Get", "Head", "Get"], "Do"))
    return table(spark, directory, "part").select("p_partkey", producer.source_class(code, F.lit("l"), args, patterns).alias("class"), outbound.alias("outbound"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS function, bool_or(c_custkey % 9 < 2) AS principal_check FROM customer GROUP BY c_nationkey""")
def principal_checks(spark, directory):
    """Functions that look at who the caller is."""
    k = F.col("c_custkey")
    return producer.principal_checks(table(spark, directory, "customer").select(F.col("c_nationkey").cast("string").alias("function"), _case(k % 9, ["CurrentUser", "IsAllowed", F.lit(None)], "userName").alias("name")))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS function, CAST(c_custkey AS INTEGER) AS line, concat('call ', c_custkey) AS text FROM customer WHERE c_custkey % 4 >= 2 AND c_custkey % 3 < 2 AND c_custkey % 5 < 2""")
def resource_access(spark, directory):
    """Calls that reach data by an identifier from the request."""
    k = F.col("c_custkey")
    arg = lambda text, *roots: F.array(F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, roots)).cast("array<string>").alias("roots")))
    args = _case(k % 5, [arg("req.UserID"), arg("itemID", "src"), arg("itemID", "lim"), arg("x", "src")])
    calls = table(spark, directory, "customer").select(
        F.col("c_nationkey").cast("string").alias("function"), F.lit("a.go").alias("file"), k.cast("int").alias("line"), _case(k % 4, [F.lit(None), "os", "repo"], "").alias("prefix"),
        _case(k % 3, ["GetItem", "Find"], "Zap").alias("name"), F.concat(F.lit("call "), k).alias("text"), args.alias("args"))
    return producer.resource_access(calls, spark.createDataFrame([("a.go", "os", "os")], "file string, alias string, path string"))


# -- reports ----------------------------------------------------------------------------------------

def _units(spark, directory) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, directory, "orders").select(
        F.col("o_custkey").alias("repo"), k.alias("unit_id"), F.col("o_orderdate").alias("place"), F.concat(F.lit("0123456789"), "o_custkey").alias("commit"),
        F.when(F.startswith("o_orderpriority", F.lit("1")), "access_control").otherwise("path_validation").alias("category"),
        F.when(s == "O", F.array(F.lit("http_request"), F.lit("read"))).when(s == "F", F.array(F.lit("read"), F.lit("odd"))).alias("source_types"),
        _case(k % 3, [judge.REPRODUCED, judge.UNREPRODUCED], judge.REFUTED).alias("verdict"), _case(k % 3, ["bug_if_holds_on_malicious_only", "timeout"], "odd_rule").alias("rule"))


_L = reports.SOURCE_LABELS


@query(f"""WITH U AS (SELECT o_custkey AS repo, o_orderkey AS unit_id, o_orderdate AS place, CASE WHEN o_orderpriority LIKE '1%' THEN 'auth' WHEN o_orderstatus = 'O' THEN 'remote' ELSE 'local' END AS section,
  CASE o_orderstatus WHEN 'O' THEN '{_L["http_request"]}、{_L["read"]}' WHEN 'F' THEN '{_L["read"]}、odd' END AS sources FROM orders WHERE o_orderkey % 3 = 0)
SELECT repo, unit_id, section, CAST(row_number() OVER (PARTITION BY repo ORDER BY CASE section WHEN 'remote' THEN 1 WHEN 'local' THEN 2 ELSE 3 END, place, unit_id) AS INTEGER) AS n, sources FROM U""")
def report_items(spark, directory):
    """Reproduced units by section, numbered in a repository, with the words for their sources."""
    return reports.items(_units(spark, directory))


@query(f"""SELECT o_custkey AS repo, o_orderkey AS unit_id, CASE o_orderkey % 3 WHEN 1 THEN '{judge.UNREPRODUCED}' ELSE '{judge.REFUTED}' END AS verdict, CASE o_orderkey % 3 WHEN 1 THEN '{reports.RULE_LABELS["timeout"]}' ELSE 'odd_rule' END AS reason FROM orders WHERE o_orderkey % 3 <> 0""")
def report_appendix(spark, directory):
    """The other units with the words for their rules."""
    return reports.appendix(_units(spark, directory))


@query("""SELECT o_custkey AS repo, '0123456789' AS commit, count(*) AS units, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS reproduced,
count(*) FILTER (o_orderkey % 3 = 2 AND o_orderkey % 4 <> 0) AS refuted, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 4 <> 0) AS unreproduced FROM orders GROUP BY o_custkey""")
def report_totals(spark, directory):
    """K7: units of a repository by verdict; some have none."""
    units = _units(spark, directory)
    return reports.totals(units, units.where(F.col("unit_id") % 4 != 0))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 IN (0, 1, 3) ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def findings_limited(spark, directory):
    """the first twenty findings (the limit is the filter's) that are low or worse, of some statuses; a missing severity is low."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    found = table(spark, directory, "orders").select("o_orderkey", "o_orderdate", _case(k % 5, ["high", F.lit(None), "none", "low"], "odd").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("x").alias("category"), F.when(s == "P", "refuted").otherwise("supported").alias("validation_status"))
    return gates.filtered_findings(found, ["x"], "low", statuses=["supported", "unknown"], limit=20, order=["o_orderdate", "o_orderkey"]).select("o_orderkey")


# -- answers ----------------------------------------------------------------------------------------

@query("""WITH O AS (SELECT o_custkey AS c, o_orderkey AS k, o_custkey % 7 AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
F AS (SELECT c, bool_or(b = 2) OR bool_or(b = 3) AS odd FROM O GROUP BY c)
SELECT CAST(c AS VARCHAR) AS batch, CAST(k AS VARCHAR) AS function_id,
CASE WHEN b IN (0, 1) THEN 'invalid_response' WHEN odd THEN 'duplicate_or_unknown_id' WHEN b = 4 AND k % 5 = 0 THEN 'missing_id' WHEN k % 8 < 5 OR k % 8 = 5 AND k % 3 <> 0 THEN 'invalid_fact_schema' END AS reason FROM O JOIN F USING (c)""")
def extraction_binding(spark, directory):
    """a customer's answer bound to its orders whole or not at all, by id, and each entry by its schema."""
    k, b = F.col("o_orderkey"), F.col("o_custkey") % 7
    o = table(spark, directory, "orders").select("o_custkey", "o_orderkey")
    fact = lambda field, kind, line: F.concat(F.lit('{"line":'), line, F.lit(f',"{field}":"'), kind, F.lit('","desc":"d"}'))
    line = F.when(k % 8 == 2, '"7"').when(k % 8 == 3, "0").when(k % 8 == 5, "70").otherwise("7")
    inputs = F.when(k % 8 == 1, "").otherwise(F.concat(F.lit('"semantic_inputs":['), fact("origin", F.lit("network"), F.lit("3")), F.lit("],")))
    sinks = F.concat(F.lit('"semantic_sinks":['), fact("kind", F.when(k % 8 == 4, "nonsense").otherwise("sql"), line), F.lit("],"))
    name = F.when(b == 5, '"function":').otherwise('"function_id":')
    entry = lambda of: F.concat(F.lit("{"), name, F.lit('"'), of, F.lit('",'), F.when(k % 8 == 0, '"purpose":5,').otherwise('"purpose":"p",'), inputs, sinks, F.lit('"observed_checks":[]}'))
    own = entry(_text_of(k))
    parts = o.where(~((b == 4) & (k % 5 == 0))).groupBy("o_custkey").agg(F.array_sort(F.collect_list(own)).alias("e"))
    c = F.col("o_custkey") % 7
    entries = F.when(c == 2, F.concat("e", F.slice("e", 1, 1))).when(c == 3, F.concat("e", F.array(F.lit('{"function_id":"zz"}')))).otherwise(F.col("e"))
    whole = F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))
    answers = o.select("o_custkey").distinct().join(parts, "o_custkey", "left").select(_text_of(F.col("o_custkey")).alias("batch"), F.when(c == 0, "no JSON").when(c == 1, '{"a": []}').otherwise(F.coalesce(whole, F.lit("[]"))).alias("response"))
    asked = o.select(_text_of(F.col("o_custkey")).alias("batch"), _text_of(k).alias("function_id"), F.when(k % 3 != 0, 1).alias("low"), F.when(k % 3 != 0, 50).alias("high"))
    return binding.bound(answers, asked).select("batch", "function_id", "reason")

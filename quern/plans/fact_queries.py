"""Queries of the rules, look-ups and scores over facts made from the driver's tables, each with its SQL.

As in ``queries``, the tables hold no code facts: a customer or an order stands for a function, a
line for a point in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import confidence, cvss, scalars
from quern.operators import graph, texts
from quern.plans import gates, judge, kb, rules, seeds, verify
from quern.plans.queries import _LINES_SQL, _ORDERS_SQL, _by_status, _facts, customer_orders, order_lines, query, table
from quern.scratch import Scratch
from quern.sources import facts
from quern.streaming import incremental


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _case(key: Column, values: list, default=None) -> Column:
    """``values[key]``, else ``default``."""
    out = F.lit(default)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(key == i, v).otherwise(out)
    return out


# -- rules ------------------------------------------------------------------------------------------

@query(f"""WITH {_LINES_SQL},
F AS (SELECT grp, pos, status, pos % 2 AS sink_line, CASE kind WHEN 'N' THEN 'v2_span' WHEN 'R' THEN 'R2' ELSE 'X4' END AS rule_id FROM L),
O AS (SELECT * FROM F a WHERE rule_id <> 'X4' AND NOT (rule_id = 'R2' AND EXISTS (SELECT 1 FROM F b WHERE b.rule_id = 'v2_span' AND b.grp = a.grp AND b.status = a.status AND b.sink_line = a.sink_line)))
SELECT CAST(grp AS VARCHAR) AS function, pos, rule_id FROM O UNION ALL
SELECT CAST(grp AS VARCHAR), pos, rule_id FROM F a WHERE rule_id = 'X4' AND NOT EXISTS (SELECT 1 FROM O b WHERE b.grp = a.grp AND b.status = a.status)""")
def rule_dedup_ordered(spark, directory):
    """Lines as findings of three rules, which yield to each other in order."""
    rule = F.when(F.col("kind") == "N", "v2_span").when(F.col("kind") == "R", "R2").otherwise("X4")
    found = order_lines(spark, directory).select(_text("grp").alias("function"), F.col("status").alias("category"), (F.col("pos") % 2).alias("sink_line"), rule.alias("rule_id"), "pos")
    return rules.ordered_dedup(found).select("function", "pos", "rule_id")


@query(f"""WITH {_LINES_SQL},
H(category, status) AS (VALUES ('access_control', 'O'), ('identity_verification', 'O'), ('origin_validation', 'O'), ('bounds_check', 'F')),
S AS (SELECT * FROM L WHERE kind = 'R' AND grp NOT IN (SELECT grp FROM L WHERE kind = 'N'))
SELECT CAST(S.grp AS VARCHAR) AS function, H.category, min(S.pos) AS source_line FROM S JOIN H ON H.status = S.status
WHERE NOT EXISTS (SELECT 1 FROM L c WHERE c.kind = 'A' AND c.grp = S.grp AND CASE c.status WHEN 'O' THEN 'access_control' ELSE 'bounds_check' END = H.category) GROUP BY ALL""")
def rule_source_only(spark, directory):
    """R-so: orders with sources and no sink, by the categories that need none."""
    lines = order_lines(spark, directory)
    sources = _facts(lines, "R", type=_by_status("http_request", "read"), desc=F.lit(""))
    out = rules.source_only_findings(sources, _facts(lines, "N"), _facts(lines, "A", category=_by_status("access_control", "bounds_check")))
    return out.select("function", "category", "source_line")


@query(f"""WITH {_LINES_SQL},
T AS (SELECT grp, CASE status WHEN 'O' THEN 'path_validation' ELSE 'resource_limit' END AS category, min(pos) AS sink_line FROM L WHERE kind = 'N' AND pos > 1 GROUP BY ALL)
SELECT CAST(grp AS VARCHAR) AS function, category, sink_line, CASE category WHEN 'path_validation' THEN 'tpl_0' ELSE '' END AS template_id,
  CASE category WHEN 'path_validation' THEN 'first' ELSE 'resource_limit_via_unbounded_read' END AS pattern_name FROM T""")
def finding_templates(spark, directory):
    """Findings with the first template of their category and a pattern name."""
    lines = order_lines(spark, directory)
    tainted = _facts(lines.where("pos > 1"), "N", sink_line=F.col("pos"), sink_type=_by_status("file_read", "unbounded_read"), sink_desc=F.lit(""), source_line=F.lit(1), source_desc=F.lit(""), provenance=F.lit("net_entry"), path=F.array().cast("array<string>")).drop("line", "ord")
    none = lines.where("false").select(F.lit("").alias("function"), F.col("pos").alias("line"), F.lit("").alias("category"))
    found = rules.taint_findings(tainted, none, None, rules.Rules.of("R2,R4"))
    templates = spark.createDataFrame([("tpl_1", 2, "path_validation", ["late"]), ("tpl_0", 1, "path_validation", ["first"])], "template_id string, rank int, category string, pattern_names array<string>")
    return rules.bound(found, templates).select("function", "category", "sink_line", "template_id", "pattern_name")


_VALIDATORS_SQL = """
V AS (SELECT CAST(c_custkey AS VARCHAR) AS function, c_custkey AS k, c_custkey % 4 <> 2 AND (c_custkey % 4 <> 1 OR c_custkey % 3 <> 1) AS fit, CASE WHEN c_custkey % 2 = 1 THEN 12 ELSE 10 END AS source_line FROM customer)"""


@query(f"""WITH {_VALIDATORS_SQL}
SELECT function, 'path_validation' AS category, CAST(source_line AS INTEGER) AS source_line, CAST(CASE k % 6 WHEN 1 THEN 15 ELSE 30 END AS INTEGER) AS sink_line FROM V WHERE fit AND k % 5 <> 0 AND k % 6 <> 0""")
def rule_validators(spark, directory):
    """Validators that hold no strong check of the purpose they serve."""
    k = F.col("c_custkey")
    c = table(spark, directory, "customer").select("c_custkey", _text("c_custkey").alias("function"))
    validators = c.select("function", _case(k % 4, ["validateTarget", "checkIt", "helper", "sanitizePath"]).alias("name"), _case(k % 3, ["bool", "string", "error"]).alias("last_result"), F.lit(10).alias("line"), F.lit(30).alias("end_line"), (k % 2 * 12).cast("int").alias("source_line"), F.array(F.lit("p")).alias("params"), F.lit("net_entry").alias("provenance"), F.array().cast("array<string>").alias("path"))
    purposes = c.where(k % 5 != 0).select("function", F.lit("path").alias("purpose"))
    checks = c.select("function", F.lit(15).alias("line"), _case(k % 6, ["filepath.Rel(a, b)", "path.Clean(x)"], "x").alias("text"))
    return rules.validator_findings(validators, purposes, checks).select("function", "category", "source_line", "sink_line")


def _validator_calls(spark, directory) -> tuple[DataFrame, DataFrame]:
    """Calls by customers of a nation, and what they resolve to."""
    k, c = F.col("c_custkey"), table(spark, directory, "customer")
    sites = c.select(k.alias("site"), F.concat(F.lit("caller"), "c_nationkey").alias("function"), k.cast("int").alias("line"), _case(k % 3, ["validatePath", "IsUserAllowed"], "other").alias("name"))
    return sites, c.select(k.alias("site"), F.concat(F.lit("v"), k % 10).alias("fid"))


@query("""SELECT DISTINCT concat('v', c_custkey % 10) AS function, CASE WHEN c_custkey % 2 = 0 THEN 'path' ELSE 'redirect' END AS purpose FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 7 <> 0""")
def validator_purposes(spark, directory):
    """Purposes of validators, from the sinks that what they check flows on to."""
    k = F.col("c_custkey")
    sites, resolved = _validator_calls(spark, directory)
    sinks = table(spark, directory, "customer").where(k % 7 != 0).select(F.concat(F.lit("caller"), "c_nationkey").alias("function"), F.when(k % 2 == 0, "file_read").otherwise("redirect").alias("type"), F.array(F.concat(F.when(k % 4 < 2, "vret:").otherwise("varg:"), k), F.lit("src")).alias("roots"))
    return rules.purposes_of(sites, sinks, resolved)


@query("""SELECT DISTINCT concat('caller', c_nationkey) AS function, CAST(c_custkey AS INTEGER) AS line, category FROM customer,
(VALUES (0, 'path_validation'), (3, 'path_validation'), (6, 'path_validation'), (9, 'path_validation'), (1, 'input_sanitization'), (4, 'input_sanitization'), (7, 'input_sanitization')) h(fid, category)
WHERE c_custkey % 3 < 2 AND c_custkey % 10 = fid AND fid <> 9""")
def validator_checks(spark, directory):
    """Calls of validators that hold a strong check are checks themselves."""
    sites, resolved = _validator_calls(spark, directory)
    n = spark.range(10).withColumn("id", F.col("id").cast("int"))
    fid = F.concat(F.lit("v"), F.col("id"))
    names = n.select(fid.alias("fid"), F.when(F.col("id") == 9, "plain").otherwise("validateIt").alias("name"))
    held = n.select(fid.alias("function"), F.lit(3).alias("line"), _case(F.col("id") % 3, ["filepath.IsLocal(p)", "ok.MatchString(p)"], "x").alias("text"))
    return rules.callee_checks(sites, resolved, held, names).select("function", "line", "category")


_ALIGN_SQL = """
A AS (SELECT concat('d', o_orderkey % 20, '.go') AS file, concat('d', o_orderkey % 20, '.go:f', o_orderkey) AS function, o_orderkey % 3 = 0 AS generic, o_orderstatus AS status, o_orderkey % 2 = 0 AS inside, o_orderkey % 5 = 0 AS short FROM orders),
P AS (SELECT file, generic, count(*) AS peers FROM A WHERE status = 'F' GROUP BY ALL),
C AS (SELECT A.*, CASE WHEN short THEN 1.0 WHEN inside THEN 1.0 ELSE 0.75 END AS ratio FROM A WHERE status = 'O')"""


def _alignments(spark, directory) -> tuple[DataFrame, DataFrame]:
    """Chains aligned to orders, and their facts."""
    k, o = F.col("o_orderkey"), table(spark, directory, "orders")
    function = F.concat(F.lit("d"), k % 20, F.lit(".go:f"), k)
    step = lambda i, line: F.struct(F.lit(i).alias("step_id"), line.cast("int").alias("line"))
    steps = F.array(step(1, F.lit(10)), step(2, F.lit(12)), step(4, 21 + (k % 2) * 100), step(5, F.lit(30)))
    segment = F.when(k % 5 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(5)))
    alignments = o.select(function.alias("function"), F.when(k % 3 == 0, "G").otherwise("T").alias("template"), F.lit(True).alias("aligned"), segment.alias("segment"), steps.alias("steps"), _case(F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1), ["absent", "present"], "unknown").alias("missing_status"), F.lit("n").alias("note"))
    chains = spark.createDataFrame([("T", "access_control", False, 3, [1, 2, 4, 5]), ("G", "access_control", True, 3, [1, 2, 4, 5])], "template string, category string, generic boolean, missing_id int, step_ids array<int>")
    functions = o.select(function.alias("function"), F.lit(1).alias("line"), F.lit(50).alias("end_line"))
    nothing = functions.where("false").select("function", "line")
    return alignments, rules.chain_facts(alignments, chains, nothing, functions)


@query(f"WITH {_ALIGN_SQL} SELECT function, generic, CAST(ratio AS DOUBLE) AS aligned_ratio, CAST(10 AS INTEGER) AS source_line, CAST(CASE WHEN short THEN 12 ELSE 30 END AS INTEGER) AS sink_line FROM C")
def chain_aligned(spark, directory):
    """Aligned segments beside an absent step, by the share of their steps that lie in the function."""
    return _alignments(spark, directory)[1].select("function", "generic", "aligned_ratio", "source_line", "sink_line")


@query(f"WITH {_ALIGN_SQL} SELECT C.function, 'access_control' AS category, CAST(ratio AS DOUBLE) AS aligned_ratio, CAST(coalesce(peers, 0) AS INTEGER) AS peers_present FROM C LEFT JOIN P ON P.file = C.file AND P.generic = C.generic WHERE NOT C.generic OR peers > 0")
def rule_chains(spark, directory):
    """Chain findings, generic ones only where a sibling performs the step."""
    alignments, found = _alignments(spark, directory)
    return rules.chain_findings(found, alignments).select("function", "category", "aligned_ratio", "peers_present")


# -- gates, priority, look-ups ----------------------------------------------------------------------

@query("""WITH C AS (SELECT CAST(c_custkey AS VARCHAR) AS function, c_nationkey % 3 = 0 AS risky, c_custkey % 4 < 2 AS named FROM customer),
O AS (SELECT CAST(o_custkey AS VARCHAR) AS function, bool_or(o_orderstatus = 'O') AS src, bool_or(o_orderstatus = 'F') AS snk, bool_or(o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS danger, count(*) FILTER (o_orderkey % 5 >= 2) AS m, bool_or(o_orderkey % 5 < 2) AS http FROM orders GROUP BY 1),
S AS (SELECT function, CAST(CASE WHEN src AND snk THEN 3 WHEN src OR snk THEN 1 + CASE WHEN danger THEN 10 ELSE 0 END ELSE 0 END + 2 * coalesce(m, 0) + CASE WHEN http THEN 2 ELSE 0 END + CASE WHEN risky THEN 2 ELSE 0 END + CASE WHEN named THEN 1 ELSE 0 END AS INTEGER) AS score FROM C LEFT JOIN O USING (function))
SELECT function, score FROM S WHERE score > 0""")
def priority_score(spark, directory):
    """C14, Q1: customers as functions, scored by their points, calls, imports and names."""
    k, o = F.col("c_custkey"), table(spark, directory, "orders")
    functions = table(spark, directory, "customer").select(_text("c_custkey").alias("function"), F.concat(F.lit("f"), "c_nationkey", F.lit(".go")).alias("file"), _case(k % 4, ["HandleX", "authUser"], "run").alias("name"))
    points = o.select(_text("o_custkey").alias("function"), _case(F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1), ["source", "sink"], "sanitizer").alias("kind"), F.when(F.startswith("o_orderpriority", F.lit("1")), "command_execution").otherwise("file_read").alias("type"))
    calls = o.select(_text("o_custkey").alias("function"), _case(F.col("o_orderkey") % 5, ["http.Get", "mux.Handle", "os.Open"], "fmt.Sum").alias("callee"))
    n = F.col("n_nationkey")
    imports = table(spark, directory, "nation").select(F.concat(F.lit("f"), n, F.lit(".go")).alias("file"), F.when(n % 3 == 0, F.array(F.lit("os/exec"), F.lit("fmt"))).otherwise(F.array(F.lit("fmt"))).alias("stdlib"))
    return gates.prioritised(functions, points, calls, imports, spark.createDataFrame([("os.Open",), ("Sum",)], "api string")).select("function", "score")


def _candidate_templates(spark, directory) -> DataFrame:
    return table(spark, directory, "part").groupBy(F.col("p_brand").alias("template_id")).agg(F.min("p_type").alias("primary_domain"), F.first("p_brand").alias("category"), F.array(F.first("p_brand")).alias("pattern_names"), F.collect_set("p_name").alias("api_indicators"), F.count("*").alias("chain_count"))


@query("""WITH T AS (SELECT p_brand, min(p_type) AS d, list(DISTINCT p_name) AS apis FROM part GROUP BY p_brand),
D AS (SELECT p_type AS d, arg_max(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size / CAST(50 AS DOUBLE) END, 0.5), p_partkey) AS c FROM part GROUP BY p_type),
U AS (SELECT list(DISTINCT p_name) AS used FROM part WHERE p_size > 25),
S AS (SELECT p_brand, len(list_intersect(apis, used)) AS overlap, CAST(0.5 AS DOUBLE) * c + CAST(0.5 AS DOUBLE) * len(list_intersect(apis, used)) / greatest(len(apis), 1) AS score FROM T JOIN D USING (d), U)
SELECT p_brand AS template_id, CAST(overlap AS INTEGER) AS overlap, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, p_brand) AS INTEGER) AS rank FROM S""")
def set_overlap_score(spark, directory):
    """Brands as templates, ranked by their domain's confidence and the part names in use."""
    p = table(spark, directory, "part")
    domains = p.select(F.col("p_type").alias("domain"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 50.0).alias("confidence"), F.col("p_partkey").alias("ord"))
    used = p.where("p_size > 25").select(F.col("p_name").alias("api"))
    return kb.candidates(_candidate_templates(spark, directory), domains, used, Scratch(spark)).select("template_id", "overlap", F.round("score", 6).alias("score"), "rank")


@query("""WITH T AS (SELECT p_brand, min(p_type) AS d, count(*) AS n FROM part GROUP BY p_brand)
SELECT CASE WHEN grouping(d) = 0 THEN 'primary_domain' WHEN grouping(p_brand) = 0 THEN 'category' ELSE 'all' END AS facet,
CASE WHEN grouping(d) = 0 THEN d WHEN grouping(p_brand) = 0 THEN p_brand END AS value, count(*) AS n, CAST(max(n) AS DOUBLE) AS top, round(avg(n), 1) AS mean
FROM T GROUP BY GROUPING SETS ((d), (p_brand), ())""")
def template_coverage(spark, directory):
    """A3: templates counted by domain and category."""
    return kb.coverage(_candidate_templates(spark, directory))


def _order_chains(spark, directory) -> DataFrame:
    """Orders as behaviour chains: a step a line."""
    step = F.struct(
        F.col("l_linenumber").cast("int").alias("step_id"), F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag")).alias("action"), (F.col("l_partkey") % 4 == 0).alias("is_missing_step"),
        F.when(F.col("l_partkey") % 4 == 0, F.col("l_linestatus")).alias("missing_step_category"), F.struct(F.array(F.concat(F.lit("p"), F.col("l_suppkey") % 3)).alias("apis")).alias("evidence"))
    return table(spark, directory, "lineitem").groupBy(F.col("l_orderkey").alias("go_id")).agg(F.sort_array(F.collect_list(step)).alias("chain")).withColumn("error", F.when(F.col("go_id") % 6 == 0, "bad"))


@query("""SELECT l_orderkey AS go_id, list_filter([CASE WHEN NOT count(*) BETWEEN 2 AND 8 THEN 'steps' END, CASE WHEN count(*) FILTER (l_partkey % 4 = 0) <> 1 THEN 'missing_step' END, CASE WHEN bool_or(l_returnflag = 'A') THEN 'action' END], lambda x: x IS NOT NULL) AS errors
FROM lineitem GROUP BY l_orderkey""")
def fact_schema_validate(spark, directory):
    """orders as chains, checked for their number of steps, missing steps and empty actions."""
    return kb.faults(_order_chains(spark, directory))


@query("""SELECT l_orderkey AS go_id, max(l_linestatus) FILTER (l_partkey % 4 = 0) AS category, CAST(max(l_linenumber) FILTER (l_partkey % 4 = 0) AS INTEGER) AS missing_id, CAST(count(DISTINCT l_suppkey % 3) AS INTEGER) AS apis
FROM lineitem WHERE l_orderkey % 6 <> 0 GROUP BY l_orderkey HAVING count(*) BETWEEN 2 AND 8 AND count(*) FILTER (l_partkey % 4 = 0) = 1 AND NOT bool_or(l_returnflag = 'A')""")
def chains_valid(spark, directory):
    """The chains that are whole, with their category and calls."""
    return kb.valid_chains(_order_chains(spark, directory)).select("go_id", "category", "missing_id", F.size("apis").alias("apis"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS function FROM customer WHERE c_nationkey % 4 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')""")
def focus_with_flow(spark, directory):
    """functions of given names and files that have a source or a sink."""
    c = table(spark, directory, "customer").select(_text("c_custkey").alias("function"), F.col("c_mktsegment").alias("name"), F.lit("").alias("receiver"), (F.col("c_nationkey") % 4).cast("string").alias("file"))
    points = table(spark, directory, "orders").select(_text("o_custkey").alias("function"), _case(F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1), ["source", "sink"], "sanitizer").alias("kind"))
    return gates.with_flow(gates.focused(c, ["BUILDING", "MACHINERY"], ["0"]), points).select("function")


@query("""SELECT p_partkey, p_size % 7 IN (1, 2, 3, 5) AS is_test FROM part""")
def test_paths(spark, directory):
    """paths of tests, helpers and examples."""
    p = F.col("p_partkey").cast("string")
    path = _case(F.col("p_size") % 7, [F.concat(F.lit("pkg/a"), p, F.lit(".go")), F.concat(F.lit("pkg/a"), p, F.lit("_test.go")), F.concat(F.lit("x/testdata/b"), p, F.lit(".go")), F.concat(F.lit("x\\e2e\\c"), p, F.lit(".go")), F.concat(F.lit("testing"), p, F.lit(".go")), F.concat(F.lit("a/mock_"), p, F.lit(".go"))], "contest/attest.go")
    return table(spark, directory, "part").select("p_partkey", gates.is_test_path(path).alias("is_test"))


@query("""SELECT p_name AS value, count(*) AS total, count(DISTINCT p_brand) AS n_files FROM part WHERE p_name <> (SELECT min(p_name) FROM part) GROUP BY p_name HAVING count(*) >= 2 AND count(DISTINCT p_brand) <= floor(150 * 0.15)""")
def mined_names(spark, directory):
    """names that are neither noise nor rare nor all over."""
    p = table(spark, directory, "part")
    noise = p.agg(F.min("p_name")).first()[0]  # a scalar
    counted = p.groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("total"), F.count_distinct("p_brand").alias("n_files"))
    return gates.mined(counted, 150, (noise,))


_SCORED_SQL = """
S AS (SELECT CAST(c_custkey AS VARCHAR) AS function, c_nationkey AS repo, CAST(CASE WHEN c_acctbal > 0 THEN c_custkey % 20 ELSE 15 END AS INTEGER) AS score, c_custkey FROM customer
  WHERE c_acctbal > 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))"""


def _scored(spark, directory) -> DataFrame:
    c = table(spark, directory, "customer").select(_text("c_custkey").alias("function"), F.col("c_nationkey").alias("repo"), "c_acctbal", "c_custkey")
    scored = c.where("c_acctbal > 0").select("function", "repo", (F.col("c_custkey") % 20).cast("int").alias("score"), F.array(F.lit("x")).alias("reasons"))
    pending = table(spark, directory, "orders").where("o_orderstatus = 'P'").select(_text("o_custkey").alias("function"))
    return gates.with_facts(scored, c.select("function", "repo"), pending)


@query(f"WITH {_SCORED_SQL} SELECT function, repo, score, CAST(row_number() OVER (PARTITION BY repo ORDER BY score DESC, function) AS INTEGER) AS place FROM S QUALIFY place <= 3")
def first_functions(spark, directory):
    """Of each nation the first three by score, those with structural facts among them."""
    return gates.first_n(_scored(spark, directory), 3).select("function", "repo", "score", "place")


@query(f"WITH {_SCORED_SQL} SELECT function, repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY c_custkey % 3 <> 0, function) AS INTEGER) AS place FROM S QUALIFY place <= 2")
def first_entries(spark, directory):
    """Of each nation the first two, entries before others."""
    entries = table(spark, directory, "customer").where("c_custkey % 3 = 0").select(_text("c_custkey").alias("function"))
    return gates.first_n(_scored(spark, directory), 2, entries).select("function", "repo", "place")


@query("""WITH X AS (SELECT replace(p_name, ' ', '_') AS name, concat(p_type, '/', p_brand, '.go') AS file, CAST(p_partkey AS INTEGER) AS n, p_size FROM part),
W AS (SELECT name, file, n, row_number() OVER (PARTITION BY name ORDER BY file, n) AS place, count(*) OVER (PARTITION BY name) AS k FROM X WHERE p_size % 6 <> 0 AND name IN (SELECT name FROM X WHERE p_size > 20))
SELECT name, file, n, k > 3 AS truncated FROM W WHERE place <= 3""")
def callers_found(spark, directory):
    """Places that call a name, three at most (the cap is the report's), and whether there are more."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    p = table(spark, directory, "part")
    lines = p.select(F.concat("p_type", F.lit("/"), "p_brand", F.lit(".go")).alias("file"), F.col("p_partkey").cast("int").alias("n"), F.concat(F.when(F.col("p_size") % 6 == 0, "func ").otherwise("y := "), name, F.lit("(z)")).alias("line"))
    return gates.callers_in_text(lines, p.where("p_size > 20").select(name.alias("name")), 3).select("name", "file", "n", "truncated")


@query("""WITH F AS (SELECT c_mktsegment || c_nationkey AS function, count(*) AS n, min(c_custkey) AS id FROM customer GROUP BY ALL)
SELECT k.function, CASE WHEN n = 1 THEN id END AS function_id, coalesce(n > 1, false) AS ambiguous FROM (SELECT c_mktsegment || (c_nationkey + 3) AS function FROM customer) k LEFT JOIN F USING (function)""")
def id_mapping(spark, directory):
    """Keys mapped to the only function that has them."""
    c = table(spark, directory, "customer")
    functions = c.select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("function"), F.col("c_custkey").alias("function_id"))
    return gates.mapped_ids(c.select(F.concat("c_mktsegment", (F.col("c_nationkey") + 3).cast("string")).alias("function")), functions)


@query("""WITH C AS (SELECT lower(n_name) AS repo, arg_max(c_name, c_custkey) AS commit FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 2 = 0 GROUP BY 1 UNION ALL SELECT 'elsewhere', max(c_name) FROM customer)
SELECT CAST(n_nationkey AS VARCHAR) AS go_id, coalesce(n_name, C.repo) AS repo, commit FROM nation FULL JOIN C ON C.repo = lower(n_name)""")
def advisory_commits(spark, directory):
    """Advisories with the last commit of their repository, and repositories that only commits name."""
    n, c = table(spark, directory, "nation"), table(spark, directory, "customer")
    here = c.where("c_nationkey % 2 = 0").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.lower("n_name").alias("repo"), F.col("c_name").alias("commit"), F.col("c_custkey").alias("ord"))
    there = c.agg(F.max("c_name").alias("commit")).select(F.lit("Elsewhere").alias("repo"), "commit", F.lit(1).cast("long").alias("ord"))
    return gates.advisories_with_commits(n.select(_text("n_nationkey").alias("go_id"), F.col("n_name").alias("repo")), here.unionByName(there))


@query("""WITH T AS (SELECT n_name AS go_id, CAST(c_custkey AS VARCHAR) AS function FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0),
J AS (SELECT go_id, o_orderstatus AS category, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS verdict FROM T LEFT JOIN orders ON CAST(o_custkey AS VARCHAR) = T.function)
SELECT go_id, count(category) AS findings, list_sort(list_filter(list(DISTINCT category), lambda x: x IS NOT NULL)) AS categories, list_sort(list_filter(list(DISTINCT verdict), lambda x: x IS NOT NULL)) AS verdicts FROM J GROUP BY go_id""")
def advisory_summary(spark, directory):
    """Of each nation's indebted customers their findings, categories and verdicts."""
    n, o = table(spark, directory, "nation"), table(spark, directory, "orders")
    indebted = table(spark, directory, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(_text("c_custkey")).alias("functions"))
    advisories = n.join(indebted, "n_nationkey", "left").select(F.col("n_name").alias("go_id"), "functions")
    found = o.select(_text("o_custkey").alias("function"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("unit_id"))
    return gates.validation_summary(advisories, found, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("verdict")))


@query("""SELECT o_orderstatus, count(*) AS calls, CAST(sum(o_orderkey % 100) AS BIGINT) AS prompt_tokens, CAST(sum(o_custkey) AS BIGINT) AS completion_tokens FROM orders GROUP BY o_orderstatus""")
def call_usage(spark, directory):
    """Calls and tokens by status."""
    o = table(spark, directory, "orders").select("o_orderstatus", (F.col("o_orderkey") % 100).cast("long").alias("prompt_tokens"), F.col("o_custkey").cast("long").alias("completion_tokens"))
    return gates.usage(o, ["o_orderstatus"])


# -- verification and verdicts ----------------------------------------------------------------------

@query("""SELECT c_nationkey AS finding_id, arg_min(c_name, c_custkey) AS c_name, list(c_mktsegment ORDER BY c_custkey) AS origins FROM customer GROUP BY c_nationkey""")
def candidates_merged(spark, directory):
    """Candidates of one id merged, the first kept, with the origins of all in order."""
    c = table(spark, directory, "customer").select(F.col("c_nationkey").alias("finding_id"), "c_name", F.array("c_mktsegment").alias("origins"), F.col("c_custkey").alias("ord"))
    return verify.merged(c)


@query("""SELECT c_custkey AS finding_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY NOT c_acctbal < 0, c_mktsegment, c_custkey % 10, c_custkey) AS INTEGER) AS place FROM customer""")
def review_queue(spark, directory):
    """Candidates in the order of review."""
    c = table(spark, directory, "customer").select(F.col("c_nationkey").alias("repo"), (F.col("c_acctbal") < 0).alias("needs_review"), F.col("c_mktsegment").alias("file"), (F.col("c_custkey") % 10).alias("line"), F.col("c_custkey").alias("finding_id"))
    return verify.triage_queue(c).select("finding_id", "place")


@query("""SELECT o_custkey AS repo, bool_or(o_orderstatus = 'P') AS partial FROM orders GROUP BY o_custkey""")
def partial_results(spark, directory):
    """Whether units are left to do."""
    units = table(spark, directory, "orders").select(F.col("o_custkey").alias("repo"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return verify.partial(units, 5)


@query("""SELECT c_custkey, substr(sha256(CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN concat('["unlocated", "', c_custkey, '"]') ELSE concat('["', c_name, '", ', c_nationkey, ', "', CASE WHEN c_custkey % 3 = 0 THEN 'other_security' ELSE c_mktsegment END, '"]') END), 1, 24) AS group_id FROM customer""")
def group_ids(spark, directory):
    """Groups of candidates by function, line and category; without a place, of their own."""
    k, c = F.col("c_custkey"), table(spark, directory, "customer")
    group = verify.group_id(_text("c_custkey"), F.when(k % 5 != 0, F.col("c_name")).otherwise(""), F.when(k % 7 != 0, F.col("c_nationkey")), F.when(k % 3 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", group.alias("group_id"))


@query("""WITH D AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id FROM D WHERE len(l) >= 2 AND doc_id % 3 <> 1 AND (trim(l[1]) <> '' OR trim(l[2]) <> '')""")
def references_valid(spark, directory):
    """quoted lines that are those of the text, but for leading white space."""
    d = table(spark, directory, "documents").select("doc_id", "text", F.concat(F.lit("f"), _text("doc_id")).alias("file"))
    first = F.split("text", "\n")
    quoted = F.concat_ws("\n", F.concat(F.lit("  "), F.get(first, F.lit(0))), F.concat(F.get(first, F.lit(1)), F.when(F.col("doc_id") % 3 == 1, "!").otherwise("")))
    refs = d.select("doc_id", "file", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), quoted.alias("text"))
    return verify.valid_references(refs, texts.lines_of(d, ["file"]), ["doc_id"]).select("doc_id")


@query(f"""WITH {_ORDERS_SQL}, N AS (SELECT o_custkey, max(pos) AS last FROM O GROUP BY o_custkey)
SELECT o_orderkey AS candidate, o_orderkey AS function_id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(-1 AS BIGINT) END AS rebound_from FROM O JOIN N USING (o_custkey) WHERE o_orderkey % 3 = 0 OR pos = last""")
def candidates_bound(spark, directory):
    """V1: candidates bound to their own function where it encloses them, else to the only one that does."""
    o = customer_orders(spark, directory).withColumn("file", _text("o_custkey"))
    functions = o.select(F.col("o_orderkey").alias("function_id"), "file", (F.col("pos") * 10 - 9).alias("line"), (F.col("pos") * 10 + 5).alias("end_line"))
    own = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(F.lit(-1)).cast("long")
    candidates = o.select(F.col("o_orderkey").alias("candidate"), own.alias("function_id"), "file", (F.col("pos") * 10 + 1).alias("start_line"), (F.col("pos") * 10 + 2).alias("end_line"))
    return verify.bound_candidates(candidates, functions).select("candidate", "function_id", "rebound_from")


@query(f"""WITH {_LINES_SQL},
C AS (SELECT grp, bool_and(pos % 7 <> 6 AND (status = 'O' OR pos % 3 <> 0)) AS valid, bool_or(pos % 7 = 0) AND bool_or(pos % 7 IN (1, 5)) AND bool_or(pos % 7 = 2) AS whole, bool_or(pos % 7 IN (3, 4)) AS against, bool_or(pos % 7 IN (1, 5) AND pos <= 5) AS anchored FROM L GROUP BY grp),
R AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS reason, o_orderkey % 5 <> 0 AS settled, valid AND anchored AND CASE WHEN o_orderstatus = 'O' THEN whole ELSE against END AS good FROM orders LEFT JOIN C ON grp = o_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS candidate, CASE WHEN s = 'P' THEN 'unknown' WHEN settled AND coalesce(good, false) THEN CASE s WHEN 'O' THEN 'supported' ELSE 'refuted' END ELSE 'unknown' END AS status,
  CASE WHEN s = 'P' OR settled AND coalesce(good, false) THEN reason ELSE 'insufficient_or_invalid_evidence' END AS reason FROM R""")
def evidence_verdicts(spark, directory):
    """V2: what responses establish, by the kinds, references and anchors of their claims; a claim a line."""
    o, lines = table(spark, directory, "orders"), order_lines(spark, directory).withColumn("candidate", _text("grp"))
    key = _text("o_orderkey")
    candidates = o.select(key.alias("candidate"), F.lit("f").alias("file"), F.lit(5).alias("sink_line"))
    status = _case(F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1), ["supported", "refuted"], "unknown")
    responses = o.select(key.alias("candidate"), key.alias("answered"), status.alias("status"), F.col("o_orderpriority").alias("reason"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("unresolved"))
    kind = _case(F.col("pos") % 7, ["input", "operation", "impact", "protection", "contradiction", "operation"], "gossip")
    claims = lines.select("candidate", F.col("pos").alias("claim"), kind.alias("kind"), F.lit("says").alias("statement"))
    refs = lines.select("candidate", F.col("pos").alias("claim"), F.lit("f").alias("file"), F.col("pos").alias("start_line"), (F.col("pos") + 4).alias("end_line"), ((F.col("status") == "O") | (F.col("pos") % 3 != 0)).alias("valid"))
    return verify.verdicts(candidates, responses, claims, refs)


_RULES_SQL = f"""
R AS (SELECT c_custkey AS unit_id, CASE WHEN c_custkey % 5 = 0 THEN 'evidence_missing' WHEN c_custkey % 7 = 0 THEN 'package_unbuildable' WHEN c_custkey % 3 = 0 THEN 'package_needs_infra'
  WHEN c_custkey % 2 = 1 THEN 'no_experiment' WHEN c_custkey % 4 = 0 THEN 'bug_if_holds_on_malicious_only' WHEN c_nationkey % 2 = 0 THEN 'blocked_by_known_guard' ELSE 'benign_also_bug' END AS rule FROM customer),
Y AS (SELECT *, CASE rule WHEN 'bug_if_holds_on_malicious_only' THEN '{judge.REPRODUCED}' WHEN 'blocked_by_known_guard' THEN '{judge.REFUTED}' ELSE '{judge.UNREPRODUCED}' END AS verdict FROM R)"""


def _judged(spark, directory) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, directory, "customer").withColumn("unit_id", F.col("c_custkey"))
    evidence = c.where(k % 5 != 0).select("unit_id", (k % 7 != 0).alias("buildable"), (k % 3 == 0).alias("needs_infra"))
    rule = F.when(k % 4 == 0, "bug_if_holds_on_malicious_only").when(F.col("c_nationkey") % 2 == 0, "blocked_by_known_guard").otherwise("benign_also_bug")
    done = c.where(k % 2 == 0).select("unit_id", judge.verdict(rule).alias("verdict"), rule.alias("rule"))
    return judge.with_prerequisites(c, evidence, done)


@query(f"WITH {_RULES_SQL} SELECT unit_id, rule, verdict FROM Y")
def verdict_rules(spark, directory):
    """V7, V8: verdicts of all units; what is missing before an experiment comes first."""
    return _judged(spark, directory).select("unit_id", "rule", "verdict")


@query(f"WITH {_RULES_SQL} SELECT rule, count(*) FILTER (verdict = '{judge.REPRODUCED}') AS reproduced, count(*) FILTER (verdict = '{judge.REFUTED}') AS refuted, count(*) FILTER (verdict = '{judge.UNREPRODUCED}') AS unreproduced, count(*) AS total FROM Y GROUP BY rule")
def verdict_counts(spark, directory):
    """Verdicts of each kind by rule."""
    return judge.counts(_judged(spark, directory), "rule")


@query(f"""WITH {_RULES_SQL}
SELECT unit_id, rule, CASE WHEN unit_id % 11 <> 0 THEN CASE WHEN unit_id % 13 = 0 THEN 'timeout' ELSE rule END END AS rule2 FROM Y WHERE unit_id % 11 = 0 OR unit_id % 13 = 0""")
def verdicts_unstable(spark, directory):
    """V9: units whose rule differs between two runs, or that one run lacks."""
    first = _judged(spark, directory)
    again = first.where("unit_id % 11 <> 0").withColumn("rule", F.when(F.col("unit_id") % 13 == 0, "timeout").otherwise(F.col("rule")))
    return judge.unstable(first, again).select("unit_id", "rule", "rule2")


# -- graphs -------------------------------------------------------------------------------------------

@query("""WITH S AS (SELECT o_orderkey, o_custkey, concat('param:', o_orderkey % 3) AS p FROM orders UNION ALL SELECT o_orderkey, o_custkey, concat('param:', o_orderkey % 3) FROM orders WHERE o_orderkey % 10 = 0),
T AS (SELECT c_custkey, 'param:0' AS root, c_custkey % 3 AS origin, c_acctbal < 0 AS d, c_nationkey % 4 AS h FROM customer UNION ALL SELECT c_custkey, 'param:1', (c_custkey + 1) % 3, c_acctbal < 0, c_nationkey % 4 FROM customer UNION ALL SELECT c_custkey, 'src', 1, false, 0 FROM customer WHERE c_custkey % 2 = 0),
B AS (SELECT p, c_custkey, arg_min(root, struct_pack(a := origin, b := d, c := h, e := NOT starts_with(root, 'param:'), f := root)) AS by_root FROM (SELECT DISTINCT o_custkey, p FROM S) JOIN T ON c_custkey = o_custkey AND (root = p OR root = 'src') GROUP BY ALL)
SELECT o_orderkey AS sink, by_root FROM S JOIN B ON B.p = S.p AND c_custkey = o_custkey""")
def sinks_reached(spark, directory):
    """Sinks with the best state among their roots; repeated sinks come out as often."""
    o, k = table(spark, directory, "orders"), F.col("c_custkey")
    sinks = o.unionByName(o.where("o_orderkey % 10 = 0")).select(F.col("o_orderkey").alias("sink"), F.col("o_custkey").alias("key"), F.array(F.concat(F.lit("param:"), F.col("o_orderkey") % 3), F.lit("src"), F.lit("lim"), F.lit("vret:4")).alias("roots"))
    state = lambda origin, dispatch, hops: F.struct(origin.cast("int").alias("origin"), dispatch.alias("dispatch"), hops.cast("int").alias("hops"))
    c = table(spark, directory, "customer")
    of = lambda r: c.select(k.alias("key"), F.lit(f"param:{r}").alias("root"), state((k + r) % 3, F.col("c_acctbal") < 0, F.col("c_nationkey") % 4).alias("state"))
    direct = c.where(k % 2 == 0).select(k.alias("key"), F.lit("src").alias("root"), state(F.lit(1), F.lit(False), F.lit(0)).alias("state"))
    return graph.reached_sinks(sinks, of(0).unionByName(of(1)).unionByName(direct), "roots", ("lim",)).select("sink", "by_root")


@query("""SELECT l_orderkey, max(l_quantity) AS state FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity > 5) = count(*)""")
def weakest_of_all(spark, directory):
    """The worst state of each key, and only of keys all of whose candidates have one."""
    lines = table(spark, directory, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("state"))
    sized = lines.join(lines.groupBy("l_orderkey").agg(F.count("*").alias("total")), "l_orderkey")
    return graph.weakest_if_all(sized, ["l_orderkey"], F.col("total"), "state")


_CYCLES_SQL = """
G AS (SELECT DISTINCT concat('s', l_suppkey) AS a, concat('p', l_partkey) AS b, l_returnflag = 'R' AS d FROM lineitem
UNION SELECT DISTINCT concat('p', l_partkey), concat('s', (l_suppkey * 7) % 13 + 1), false FROM lineitem)"""


@query(f"""WITH RECURSIVE {_CYCLES_SQL},
R AS (SELECT concat('s', s_suppkey) AS node, s_nationkey % 3 AS origin, false AS dispatch, 0 AS hops FROM supplier WHERE s_suppkey % 4 = 1
UNION SELECT G.b, R.origin, R.dispatch OR G.d, R.hops + 1 FROM R JOIN G ON G.a = R.node WHERE R.hops < 3),
B AS (SELECT node, min(struct_pack(origin := origin, dispatch := dispatch, hops := hops)) AS b FROM R GROUP BY node)
SELECT node, CAST(b.origin AS INTEGER) AS origin, b.dispatch AS dispatch, CAST(b.hops AS INTEGER) AS hops FROM B""")
def reach_bounded(spark, directory):
    """What suppliers reach in three hops over parts and back, by the best origin, dispatch and hops; many paths, ties and cycles."""
    lines = table(spark, directory, "lineitem")
    out = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("caller"), F.concat(F.lit("p"), "l_partkey").alias("callee"), (F.col("l_returnflag") == "R").alias("dispatch"))
    back = lines.select(F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("s"), (F.col("l_suppkey") * 7) % 13 + 1).alias("callee"), F.lit(False).alias("dispatch"))
    seeds_ = table(spark, directory, "supplier").where("s_suppkey % 4 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), (F.col("s_nationkey") % 3).cast("int").alias("origin"), F.lit("seed").alias("label"))
    edges = out.unionByName(back).distinct().withColumn("label", F.col("caller"))
    return graph.reach(edges, seeds_, 3, Scratch(spark)).select("node", "state.origin", "state.dispatch", "state.hops")


# -- scores and scalars -------------------------------------------------------------------------------

@query("""SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 5 THEN 1.0 ELSE 0.4 END AS DOUBLE) AS score,
CASE c_custkey % 6 WHEN 0 THEN 'no_evidence' WHEN 1 THEN 'source_unavailable' WHEN 2 THEN 'verified_citation' WHEN 5 THEN 'verified_citation' ELSE 'unverified_citation' END AS provenance FROM customer""")
def evidence_score(spark, directory):
    """Citations of lines and of code, held against the source."""
    k = F.col("c_custkey") % 6
    evidence = _case(k, [F.lit(" "), F.lit("L10 x"), F.lit("L10 → L12"), F.lit("L10 → L19"), F.lit("see `os.Exec(p)`"), F.lit("see `os.Open(p)` there")])
    source = F.when(k != 1, F.concat(F.lit("a\n\tos.Open(p)\n"), "c_name"))
    score, name = confidence.code_evidence(evidence, source, F.lit(10))
    return table(spark, directory, "customer").select("c_custkey", score.alias("score"), name.alias("provenance"))


@query("""SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.2 WHEN 4 THEN 0.1 ELSE 0.5 END AS DOUBLE) AS score,
CASE p_size % 6 WHEN 0 THEN 'no_data_flow' WHEN 1 THEN 'source_and_sink' WHEN 2 THEN 'source_only' WHEN 3 THEN 'no_match' WHEN 4 THEN 'sanitizer_on_path' ELSE 'sanitizer_off_path' END AS provenance FROM part""")
def flow_score(spark, directory):
    """Spans corroborated by the function's own flow facts."""
    k = F.col("p_size") % 6
    none = F.array().cast("array<string>")
    sources = F.when(k.isin(1, 2, 4, 5), F.array(F.lit("read"))).otherwise(none)
    sinks = F.when(k.isin(1, 4, 5), F.array(F.lit("file_read"))).otherwise(none)
    check = lambda line: F.array(F.struct(F.lit("path_validation").alias("category"), F.lit(line).alias("line")))
    checks = F.when(k == 4, check(15)).when(k == 5, check(30)).otherwise(F.filter(check(0), lambda c: c["line"] > 0))
    score, name = confidence.flow_corroboration(F.lit("path_validation"), k != 0, sources, sinks, F.array(F.lit(10), F.lit(20)), checks)
    return table(spark, directory, "part").select("p_partkey", score.alias("score"), name.alias("provenance"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.65 WHEN 3 THEN 0.4 WHEN 4 THEN 0.6 WHEN 5 THEN 0.66 ELSE 0.2 END AS DOUBLE) AS second,
CAST(CASE o_orderkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 1.0 WHEN 3 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS third FROM orders WHERE o_orderkey % 7 <> 5 OR true""")
def support_score(spark, directory):
    """The second dimension by rule, the third by template."""
    k, t = F.col("o_orderkey") % 7, F.col("o_orderkey") % 5
    f = {
        "rule_id": _case(k, ["R1", "R1", "R2", "R3", "R5", "X4"], "v2_span"), "source_line": F.when(k == 0, 3).otherwise(4), "flow_source_lines": F.array(F.lit(3), F.lit(5)),
        "source_provenance": F.lit("net_nhop"), "hops": F.lit(3), "purpose_inferred": F.lit(True), "sink_desc": F.lit(""), "aligned_ratio": F.lit(0.8), "peers_present": F.lit(2)}
    third = confidence.template_support(F.lit("R2"), F.lit(False), t != 0, t != 1, t.isin(2, 4), t != 4)
    return table(spark, directory, "orders").select("o_orderkey", confidence.corroboration(f, F.lit(0.2)).alias("second"), third.alias("third"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 THEN 'L' ELSE 'N' END AS av, CASE WHEN p_size % 3 = 0 THEN 'ast_fact' WHEN p_size % 2 = 0 THEN 'llm' ELSE 'category_default' END AS av_origin,
CASE WHEN p_size % 5 = 0 THEN 'H' ELSE 'N' END AS i, CASE WHEN p_size % 5 = 0 THEN 'sink_upgrade' ELSE 'category_default' END AS i_origin FROM part""")
def cvss_by_facts(spark, directory):
    """Metrics supplied, defaulted, and raised by facts, with where they come from."""
    s = F.col("p_size")
    given = F.when(s % 2 == 0, F.create_map(F.lit("AV"), F.lit("local")))
    types = lambda when, name: F.when(when, F.array(F.lit(name)))
    m, origin = cvss.resolved(given, F.lit("path_validation"), types(s % 3 == 0, "http_request"), types(s % 5 == 0, "file_write"))
    p = table(spark, directory, "part").select("p_partkey", m.alias("m"), origin.alias("o"))
    return p.select("p_partkey", F.col("m.AV").alias("av"), F.col("o.AV").alias("av_origin"), F.col("m.I").alias("i"), F.col("o.I").alias("i_origin"))


_STOPS = ", ".join(f"'{w}'" for w in seeds.STOP_WORDS)


@query(f"""SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 2 AND NOT list_contains([{_STOPS}], x)))) AS tokens FROM part""")
def camel_tokens(spark, directory):
    """C4: words of camel-case names."""
    return table(spark, directory, "part").select("p_partkey", scalars.name_tokens(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("tokens"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('a_b', c_custkey, '_', substr(sha256(concat('a/b', c_custkey)), 1, 8)) ELSE concat('a_b', c_custkey) END AS safe,
CASE c_custkey % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 END AS rejected, CASE c_custkey % 3 WHEN 0 THEN 'net_entry' WHEN 1 THEN 'wire_1hop_dispatch' ELSE 'io_nhop' END AS origin,
CASE c_custkey % 3 WHEN 0 THEN 'github.com/a/b' WHEN 1 THEN 'github.com/golang/go' ELSE 'plain' END AS repository, CASE c_custkey % 3 WHEN 2 THEN 'plain' WHEN 0 THEN 'c' ELSE 'net' END AS alias, c_custkey % 3 = 2 AS standard FROM customer""")
def scalar_helpers(spark, directory):
    """File names, rejecting statuses, provenances, repositories and packages."""
    k = F.col("c_custkey")
    result = F.when(k % 4 == 0, F.create_map(F.lit("status"), F.lit("404"))).when(k % 4 == 1, F.create_map(F.lit("code"), F.lit("500"))).otherwise(F.create_map(F.lit("status"), F.lit("true")))
    module = _case(k % 3, ["github.com/a/b/go-c/v2", "golang.org/x/net"], "plain")
    third = k % 3
    return table(spark, directory, "customer").select(
        "c_custkey", scalars.safe_name(F.concat(F.lit("a/b"), k), k % 2 == 0).alias("safe"), scalars.rejected_status(result).alias("rejected"),
        scalars.provenance(third.cast("int"), third.cast("int"), third == 1, F.lit(False)).alias("origin"), scalars.repository(module, F.lit(None).cast("string")).alias("repository"),
        scalars.alias_of(module).alias("alias"), scalars.is_standard_package(module).alias("standard"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['b.F', concat(p_brand_, '.G')] ELSE [concat(p_brand_, '.G')] END AS calls, CASE WHEN p_size % 2 = 0 THEN ['F', 'G', 'plain'] ELSE ['G', 'plain'] END AS names
FROM (SELECT *, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS p_brand_ FROM part)""")
def calls_named(spark, directory):
    """Dotted calls and called names of a text."""
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "x := a.b.F(1)\n").otherwise("if ok {\n"), F.lit("plain(2) ; "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(".G(3); return (4)"))
    return table(spark, directory, "part").select("p_partkey", texts.calls_in(text).alias("calls"), texts.called_names(text).alias("names"))


# -- state and sources --------------------------------------------------------------------------------

@query("""SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT concat('more', n_nationkey), 'new' FROM nation""")
def rows_upserted(spark, directory):
    """K9: old rows but those whose key is written anew, and the new ones."""
    c = table(spark, directory, "customer").select(_text("c_custkey").alias("k"))
    new = c.where("CAST(k AS INT) % 3 = 0").unionByName(table(spark, directory, "nation").select(F.concat(F.lit("more"), "n_nationkey").alias("k")))
    return incremental.upserted(c.withColumn("v", F.lit("old")), new.withColumn("v", F.lit("new")), ["k"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS v FROM customer""")
def rows_kept(spark, directory):
    """2.15: an empty new field keeps the old one."""
    c = table(spark, directory, "customer")
    old = c.select("c_custkey", F.col("c_mktsegment").alias("v"))
    return incremental.kept_when_empty(old, c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("v")), ["c_custkey"])


@query("""SELECT o_custkey, count(*) FILTER (o_custkey % 3 = 0) AS hits, count(*) FILTER (o_custkey % 3 <> 0) AS misses FROM orders GROUP BY o_custkey""")
def replies_cached(spark, directory):
    """X-d: requests answered from recorded replies by the hash of their payload, and those that aren't."""
    asked = table(spark, directory, "orders").select("o_custkey", "o_orderkey")
    known = table(spark, directory, "customer").where("c_custkey % 3 = 0").select(F.sha2(F.to_json(F.struct(F.col("c_custkey").alias("o_custkey"))), 256).alias("cache_key"), F.lit("reply").alias("reply"))
    hits, misses = incremental.cached(asked, known, ["o_custkey"])
    both = hits.select("o_custkey", F.lit(1).alias("hit")).unionByName(misses.select("o_custkey", F.lit(0).alias("hit")))
    return both.groupBy("o_custkey").agg(F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


@query("""SELECT c_nationkey AS repo, concat('example.com/', c_mktsegment, '/', c_custkey) AS module, concat('m', c_custkey) AS rel_dir,
CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY length(concat(c_mktsegment, c_custkey)) DESC, concat('example.com/', c_mktsegment, '/', c_custkey)) AS INTEGER) AS place FROM customer WHERE c_custkey % 4 <> 0""")
def modules_ordered(spark, directory):
    """Modules of a repository, longest first; files without a module drop."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("// a module\n"), F.when(k % 4 != 0, "module ").otherwise("require "), F.lit("example.com/"), "c_mktsegment", F.lit("/"), k, F.lit("\n\ngo 1.22\n"))
    return facts.modules_of(table(spark, directory, "customer").select(F.col("c_nationkey").alias("repo"), F.concat(F.lit("m"), k, F.lit("/go.mod")).alias("path"), text.alias("text")))


_STRUCTURES_SQL = """
A AS (SELECT o_custkey, o_orderkey, concat('d', o_custkey, '/f', o_orderkey, '.go') AS file, o_orderstatus FROM orders)"""


def _analysis(spark, directory) -> DataFrame:
    """Customers as packages of one repository, their orders as functions with a source and a sink each."""
    o = table(spark, directory, "orders")
    file = F.concat(F.lit("f"), "o_orderkey", F.lit(".go"))
    function = F.struct(file.alias("file"), F.lit("F").alias("name"), F.lit("").alias("receiver"), F.lit(1).alias("line"), F.array(F.lit("os.Open")).alias("calls"))
    point = lambda line, kind: F.struct(F.lit(line).alias("line"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("category"), F.lit(kind).alias("pattern"))
    none = F.filter(F.array(point(0, "")), lambda p: p["line"] > 0)
    flow = F.struct(file.alias("file"), F.lit("F").alias("function"), F.array(point(3, "read")).alias("sources"), F.when(F.col("o_orderstatus") == "O", F.array(point(9, "file_write"), point(12, "write"))).otherwise(none).alias("sinks"), F.lit(None).cast(f"array<{facts._POINT}>").alias("sanitizers"))
    packed = o.groupBy("o_custkey").agg(F.collect_list(function).alias("functions"), F.collect_list(flow).alias("data_flow_indicators"))
    raw = packed.select(F.lit("r").alias("repo"), F.lit("s").alias("snapshot"), F.concat(F.lit("d"), "o_custkey").alias("dir"), "functions", "data_flow_indicators")
    return raw.select(F.from_json(F.to_json(F.struct("*")), facts.ANALYSIS).alias("x")).select("x.*")


@query(f"""WITH {_STRUCTURES_SQL} SELECT concat(file, ':F') AS function, 'source' AS kind, CAST(3 AS INTEGER) AS line, 'read' AS type FROM A
UNION ALL SELECT concat(file, ':F'), 'sink', line, type FROM A, (VALUES (CAST(9 AS INTEGER), 'file_write'), (CAST(12 AS INTEGER), 'write')) p(line, type) WHERE o_orderstatus = 'O'""")
def producer_points(spark, directory):
    """The producer's JSON of many packages as one table of points."""
    return facts.merged_tables(_analysis(spark, directory))["flow_points"].select("function", "kind", "line", "type")


@query(f"""WITH {_STRUCTURES_SQL}
SELECT concat(file, ':F') AS function, category, CAST(3 AS INTEGER) AS source_line, CAST(9 AS INTEGER) AS sink_line, 'critical' AS severity FROM A, (VALUES ('path_validation')) c(category) WHERE o_orderstatus = 'O'""")
def detect(spark, directory):
    """End to end: the producer's JSON through facts, spans, templates, confidence and severity to filtered findings."""
    from quern.plans import detect as plan

    found = plan.detected(_analysis(spark, directory), plan.Recorded.nothing(spark), rules.Rules.of("v2,F3"))
    return found.select("function", "category", "source_line", "sink_line", "severity")


@query("""WITH D AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
G AS (SELECT doc_id, regexp_matches(l[1], '\\S') AS g0, len(l) >= 2 AND doc_id % 3 <> 0 AND regexp_matches(coalesce(l[2], ''), '[^ ]') AS g1, len(l) >= 3 AND len(list_filter(l[1:3], lambda x: regexp_matches(x, '\\S'))) > 0 AS g2 FROM D)
SELECT doc_id AS candidate, CASE WHEN g1 THEN [1, 2] ELSE [1] END || CASE WHEN g2 THEN [1] ELSE [] END AS evidence, CASE WHEN g1 THEN [] ELSE [1] END || CASE WHEN g2 THEN [] ELSE [2] END AS warned, CAST(1 + CAST(NOT (g1 AND g2) AS INTEGER) AS INTEGER) AS questions FROM G WHERE g0""")
def candidates_referenced(spark, directory):
    """V1: candidates whose first reference holds, with warnings for the others that don't."""
    d = table(spark, directory, "documents").where("text is not null").select("doc_id", "text", F.concat(F.lit("f"), _text("doc_id")).alias("file"))
    first = F.split("text", "\n")
    ref = lambda position, start, end, text: F.struct(F.lit(position).alias("position"), F.lit(start).alias("start_line"), F.lit(end).alias("end_line"), text.cast("string").alias("text"))
    refs = F.array(ref(0, 1, 1, F.concat(F.lit("\t"), F.get(first, F.lit(0)))), ref(1, 2, 2, F.concat(F.coalesce(F.get(first, F.lit(1)), F.lit("gone")), F.when(F.col("doc_id") % 3 == 0, "!").otherwise(""))), ref(2, 1, 3, F.lit(None)))
    each = d.select(F.col("doc_id").alias("candidate"), "file", F.explode(refs).alias("r")).select("candidate", "file", "r.*")
    candidates = d.select(F.col("doc_id").alias("candidate"), F.array(F.lit("why")).alias("questions"))
    out = verify.referenced(candidates, each, texts.lines_of(d, ["file"]))
    return out.select("candidate", F.col("evidence.start_line").alias("evidence"), F.col("reference_warnings.index").alias("warned"), F.size("questions").alias("questions"))


@query(f"""WITH {_LINES_SQL},
P AS (SELECT grp, CASE kind WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS rank, pos, concat(kind, ':', pos, ':', status) AS what FROM L WHERE kind <> 'N' OR status = 'O'),
G AS (SELECT grp, list(what ORDER BY rank, pos) AS what FROM P GROUP BY grp)
SELECT CAST(L.grp AS VARCHAR) AS function, L.pos AS sink_line, coalesce(G.what, []) AS held FROM L LEFT JOIN G USING (grp) WHERE L.kind = 'N' AND L.status = 'F'""")
def protections_retained(spark, directory):
    """Retain: findings with all that may protect them, in order: checks, range checks, sanitizers."""
    lines = order_lines(spark, directory)
    of = lambda kind, name: _facts(lines, kind, **{name: F.col("status")}).drop("ord")
    sanitizers = _facts(lines.where("status = 'O'"), "N", pattern=F.col("status")).drop("ord")
    findings = _facts(lines.where("status = 'F'"), "N", sink_line=F.col("pos")).select("function", "sink_line")
    out = rules.with_protections(findings, of("A", "category"), of("R", "var"), sanitizers)
    letter = lambda p: F.when(p["kind"] == "check", "A").when(p["kind"] == "range_check", "R").otherwise("N")
    return out.select("function", "sink_line", F.transform("protection_hypotheses", lambda p: F.concat_ws(":", letter(p), p["line"].cast("string"), p["what"])).alias("held"))

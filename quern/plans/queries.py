"""Queries over the driver's tables: each runs an operator on data of its shape, over whole tables.

The tables hold no code facts, so the queries show what an operator computes, not what a
finding means.  Every query has the same in DuckDB's SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import confidence, cvss, scalars
from quern.operators import aggregates, graph, matching, ranks, retrieval, spans, texts
from quern.operators.null_safe import null_safe_join
from quern.plans import gates, judge, rules, seeds, verify
from quern.scratch import Scratch
from quern.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


# -- spans ---------------------------------------------------------------------------------------

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_LINES_SQL = f"""
L AS (SELECT l_orderkey AS grp, l_returnflag AS kind, l_linestatus AS status, l_quantity AS quantity, l_partkey AS part,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS INTEGER) AS pos
      FROM lineitem)"""


def order_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of each order in a total order: grp, kind, status, quantity, part, pos."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    rows = table(spark, directory, "lineitem").withColumn("pos", F.row_number().over(w))
    return rows.select(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("part"), "pos")


def of_kind(lines: DataFrame, kind: str, *extra: str) -> DataFrame:
    return lines.where(F.col("kind") == kind).select("grp", "pos", *extra)


_EVENTS_SQL = """
E AS (SELECT user_id, event_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos FROM events)"""


def user_events(spark: SparkSession, directory: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, directory, "events").select("user_id", "event_id", "event_type", "value", F.row_number().over(w).alias("pos"))


@query(f"""WITH {_EVENTS_SQL}
SELECT k.user_id, min(s.pos) AS source_pos, k.pos AS sink_pos
FROM E k JOIN E s ON s.user_id = k.user_id AND s.pos < k.pos AND s.event_type = 'view'
WHERE k.event_type = 'purchase' AND NOT EXISTS (
    SELECT 1 FROM E c WHERE c.user_id = k.user_id AND c.event_type = 'signup' AND c.pos > s.pos AND c.pos < k.pos)
GROUP BY k.user_id, k.pos""")
def span_unprotected(spark, directory):
    """The earliest view before each purchase of a user without a signup between."""
    is_ = lambda t: F.col("event_type") == t
    return spans.first_unprotected(user_events(spark, directory), ["user_id"], "pos", is_("view"), is_("purchase"), is_("signup"))


_PAIRS_SQL = f"""{_LINES_SQL},
P AS (SELECT s.grp, s.pos AS source_pos, k.pos AS sink_pos FROM L s JOIN L k ON s.grp = k.grp
      WHERE s.kind = 'R' AND k.kind = 'N' AND s.pos <> k.pos AND NOT (s.pos - k.pos BETWEEN 1 AND 2)
        AND NOT EXISTS (SELECT 1 FROM L c WHERE c.grp = s.grp AND c.kind = 'A' AND c.pos > least(s.pos, k.pos) AND c.pos < greatest(s.pos, k.pos)))"""


def _pairs(spark, directory) -> DataFrame:
    lines = order_lines(spark, directory)
    pairs = spans.span_join(of_kind(lines, "R"), of_kind(lines, "N"), ["grp"], "pos")
    return spans.unprotected(pairs, of_kind(lines, "A"), ["grp"], "pos")


@query(f"WITH {_PAIRS_SQL} SELECT grp, source_pos, sink_pos FROM P")
def span_pairs(spark, directory):
    """All pairs of an order's R and N lines without an A line between."""
    return _pairs(spark, directory).select("grp", "source_pos", "sink_pos")


@query(f"WITH {_PAIRS_SQL} SELECT grp, min(source_pos) AS source_pos, sink_pos FROM P GROUP BY grp, sink_pos")
def span_collapse_sink(spark, directory):
    """Of each sink the earliest source."""
    return spans.collapsed(_pairs(spark, directory), ["grp", "sink_pos"], [F.col("source_pos")]).select("grp", "source_pos", "sink_pos")


@query(f"""WITH {_PAIRS_SQL} SELECT grp, source_pos, sink_pos FROM (
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(sink_pos - source_pos) DESC, source_pos, sink_pos) AS r FROM P) WHERE r = 1""")
def span_collapse_widest(spark, directory):
    """Of each order the widest pair."""
    return spans.collapsed(_pairs(spark, directory), ["grp"], [-F.abs(F.col("sink_pos") - F.col("source_pos")), F.col("source_pos"), F.col("sink_pos")]).select("grp", "source_pos", "sink_pos")


@query(f"""WITH {_LINES_SQL} SELECT s.grp, s.pos, coalesce((SELECT n.pos FROM L n WHERE n.grp = s.grp AND n.kind = 'N' AND abs(n.pos - s.pos) <= 2
ORDER BY abs(n.pos - s.pos), n.pos LIMIT 1), s.pos) AS snapped FROM L s WHERE s.kind = 'R'""")
def fact_snap(spark, directory):
    """Each R line moved to the nearest N line within two, ties to the smaller."""
    lines = order_lines(spark, directory)
    return spans.snap(of_kind(lines, "R"), of_kind(lines, "N"), ["grp"], "pos").select("grp", "pos", "snapped")


@query(f"""WITH {_LINES_SQL},
S AS (SELECT grp, pos, status AS type, CAST(part AS VARCHAR) AS d FROM L WHERE kind <> 'A'),
W0 AS (SELECT grp, pos AS own, status AS type, CAST(part AS VARCHAR) AS d FROM L WHERE kind = 'A'),
W AS (SELECT w.grp, w.own, w.type, w.d, coalesce((SELECT s.pos FROM S s WHERE s.grp = w.grp AND s.type = w.type AND abs(s.pos - w.own) <= 2 ORDER BY abs(s.pos - w.own), s.pos LIMIT 1), w.own) AS pos FROM W0 w),
T AS (SELECT grp, pos, type, arg_max(d, own) AS d FROM W GROUP BY ALL)
SELECT s.grp, s.pos, s.type, coalesce(t.d, s.d) AS d, true AS strong FROM S s LEFT JOIN T t ON s.grp = t.grp AND s.pos = t.pos AND s.type = t.type
UNION ALL
SELECT t.grp, t.pos, t.type, t.d, false FROM T t WHERE NOT EXISTS (SELECT 1 FROM S s WHERE s.grp = t.grp AND s.pos = t.pos)""")
def fact_merge(spark, directory):
    """Two channels of facts merged, the strong one first."""
    lines = order_lines(spark, directory).select("grp", "pos", F.col("status").alias("type"), F.col("part").cast("string").alias("d"), F.col("pos").alias("ord"), "kind")
    return spans.merged_facts(lines.where("kind <> 'A'").drop("kind"), lines.where("kind = 'A'").drop("kind"), ["grp"], "pos", "type", "d")


@query(f"""WITH {_EVENTS_SQL} SELECT p.event_id, min(v.pos) AS first_pos FROM E p JOIN E v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.pos < p.pos
WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def first_prior_source(spark, directory):
    """A user's first view before each purchase."""
    e = user_events(spark, directory)
    return spans.first_before(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "pos").select("event_id", "first_pos")


@query(f"""WITH {_EVENTS_SQL} SELECT e.event_id, (SELECT c.value FROM E c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.pos <= e.pos ORDER BY c.pos DESC LIMIT 1) AS click_value
FROM E e WHERE e.event_type = 'error'""")
def as_of_latest(spark, directory):
    """The value of a user's latest click at or before each error."""
    e = user_events(spark, directory)
    return spans.latest_at(e.where("event_type = 'error'"), e.where("event_type = 'click'"), ["user_id"], "pos", "value", "click_value").select("event_id", "click_value")


@query(f"""WITH {_LINES_SQL} SELECT grp, pos, prior_pos, nth FROM (
SELECT n.grp, n.pos, r.pos AS prior_pos, CAST(row_number() OVER (PARTITION BY n.grp, n.pos ORDER BY r.pos DESC) AS INTEGER) AS nth
FROM L n JOIN L r ON r.grp = n.grp AND r.pos < n.pos WHERE n.kind = 'N' AND r.kind = 'R') WHERE nth <= 2""")
def preceding_top(spark, directory):
    """The two latest R lines before each N line of an order."""
    lines = order_lines(spark, directory)
    return spans.preceding_top(of_kind(lines, "N"), of_kind(lines, "R"), ["grp"], "pos", 2, ["grp", "pos"], []).select("grp", "pos", "prior_pos", "nth")


_ORDERS_SQL = """O AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS pos FROM orders)"""


def customer_orders(spark, directory) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, directory, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("pos"))


@query(f"""WITH {_ORDERS_SQL}, R AS (SELECT o_custkey, pos AS first, pos + 2 AS last, o_orderkey AS span_id FROM O WHERE pos % 2 = 1)
SELECT p.o_orderkey, r.span_id FROM O p JOIN R r ON r.o_custkey = p.o_custkey AND p.pos BETWEEN r.first AND r.last""")
def line_interval_join(spark, directory):
    """A customer's orders in overlapping spans of three."""
    orders = customer_orders(spark, directory)
    ranges = orders.where("pos % 2 = 1").select("o_custkey", F.col("pos").alias("first"), (F.col("pos") + 2).alias("last"), F.col("o_orderkey").alias("span_id"))
    return spans.enclosing(orders, ranges, ["o_custkey"], "pos", "first", "last").select("o_orderkey", "span_id")


@query(f"""WITH {_LINES_SQL} SELECT f.grp, f.pos FROM L f WHERE f.kind = 'A' AND (
NOT EXISTS (SELECT 1 FROM L n WHERE n.grp = f.grp AND n.kind = 'N') OR EXISTS (SELECT 1 FROM L n WHERE n.grp = f.grp AND n.kind = 'N' AND abs(n.pos - f.pos) <= 1))""")
def near_lines(spark, directory):
    """A lines beside an N line of their order, or all where there is none."""
    lines = order_lines(spark, directory)
    return spans.near_any(of_kind(lines, "A"), of_kind(lines, "N"), ["grp"], "pos")




# -- prefixes, patterns, resolution ----------------------------------------------------------------

_URL = r"^[a-z]+://([^?#]*)"


def page_paths(spark, directory) -> DataFrame:
    return table(spark, directory, "pages").select("page_id", F.regexp_extract("url", _URL, 1).alias("path"))


@query(f"""WITH P AS (SELECT page_id, regexp_extract(url, '{_URL}', 1) AS path FROM pages),
X AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM P UNION SELECT DISTINCT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) FROM P WHERE page_id % 2 = 0)
SELECT p.page_id, arg_max(x.prefix, length(x.prefix)) AS prefix FROM P p JOIN X x ON p.path = x.prefix OR starts_with(p.path, concat(x.prefix, '/')) GROUP BY p.page_id""")
def longest_prefix(spark, directory):
    """Each page with the longest known prefix of its path: its host, or host and first segment where some even page has it."""
    pages = page_paths(spark, directory)
    part = F.split("path", "/")
    hosts = pages.select(F.element_at(part, 1).alias("prefix"))
    deeper = pages.where("page_id % 2 = 0").select(F.concat(F.element_at(part, 1), F.lit("/"), F.coalesce(F.get(part, F.lit(1)), F.lit(""))).alias("prefix"))
    return matching.longest_prefix(pages, hosts.union(deeper).distinct(), "path", "prefix").select("page_id", "prefix")


#: Example patterns in order of rank, their kinds and the language that gates them.
_PATTERNS = [(1, "###", "marks", None), (2, " | ", "list", None), (3, "und", "german", "de"), (4, "les", "french", "fr"), (5, "the", "english", "en"), (6, "an", "any", None)]


@query("""WITH X(rank, pattern, kind, gate) AS (VALUES (1, '###', 'marks', NULL), (2, ' | ', 'list', NULL), (3, 'und', 'german', 'de'), (4, 'les', 'french', 'fr'), (5, 'the', 'english', 'en'), (6, 'an', 'any', NULL))
SELECT d.doc_id, arg_min(x.pattern, x.rank) AS pattern, arg_min(x.kind, x.rank) AS kind FROM documents d JOIN X x ON contains(d.text, x.pattern) AND (x.gate IS NULL OR x.gate = d.lang) GROUP BY d.doc_id""")
def pattern_first_match(spark, directory):
    """The first pattern that a text contains, where its language opens the pattern's gate."""
    patterns = spark.createDataFrame(_PATTERNS, "rank int, pattern string, kind string, gate string")
    docs = table(spark, directory, "documents").select("doc_id", "text", "lang")
    gate = F.col("__gate").isNull() | (F.col("__gate") == F.col("lang"))
    return matching.first_pattern(docs, patterns, ["doc_id"], "text", gate=gate)


@query("""SELECT s_suppkey, count(*) AS parts FROM (SELECT DISTINCT l_suppkey AS s_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
WHERE p_name LIKE '%ring%' OR p_name LIKE '%blue%' OR p_name LIKE '%red widget%' OR contains('large red widget', p_name) GROUP BY s_suppkey""")
def bidirectional_match(spark, directory):
    """How many part names of each supplier contain, or are contained in, a known name."""
    names = spark.createDataFrame([("ring",), ("blue",), ("large red widget",), ("red widget",)], "name string")
    parts = table(spark, directory, "part").select("p_partkey", "p_name")
    calls = table(spark, directory, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("s_suppkey", "p_name").distinct()
    return matching.matching_calls(calls, names, ["s_suppkey"], "p_name", "name").withColumnRenamed("matching", "parts")


@query("""WITH T AS (
SELECT c_custkey, 0 AS tier, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000)
UNION ALL SELECT c_custkey, 1, min(s_suppkey) FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey
UNION ALL SELECT c_custkey, 2, min(s_suppkey) FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN nation m ON m.n_regionkey = n.n_regionkey JOIN supplier s ON s.s_nationkey = m.n_nationkey GROUP BY c_custkey)
SELECT c_custkey, s_suppkey, CAST(tier AS INTEGER) AS tier FROM T WHERE tier = (SELECT min(tier) FROM T u WHERE u.c_custkey = T.c_custkey)""")
def tiered_resolution(spark, directory):
    """Customers resolved to suppliers: of their nation and balance class, else the first of the nation, else of the region."""
    c = table(spark, directory, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("class"))
    s = table(spark, directory, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.floor(F.col("s_acctbal") / 1000).alias("class"))
    n = table(spark, directory, "nation")
    by_nation = s.groupBy("c_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    region = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    by_region = by_nation.join(region, "c_nationkey").groupBy("n_regionkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    tiers = [(0, ["c_nationkey", "class"], s), (1, ["c_nationkey"], by_nation), (2, ["n_regionkey"], by_region)]
    return matching.first_tier(c.join(region, "c_nationkey", "left"), ["c_custkey"], tiers, ["s_suppkey"], Scratch(spark)).select("c_custkey", "s_suppkey", "tier")


_SITES_SQL = """
F AS (SELECT p_partkey AS fid, p_brand AS dir, CASE WHEN p_size % 3 = 0 THEN p_type END AS recv, p_name AS name, p_size % 4 AS n_params, p_size % 5 = 0 AS variadic, concat(p_name, CAST(p_size % 4 AS VARCHAR)) AS sig FROM part),
S AS (SELECT p_partkey AS site, p_brand AS dir, CASE WHEN p_size % 2 = 0 THEN p_type END AS recv, CASE WHEN p_size % 7 = 0 THEN concat('Brand#', CAST(p_size % 25 + 1 AS VARCHAR)) END AS pkg, p_name AS name, p_size % 4 AS nargs, p_size % 2 = 0 AS dynamic FROM part),
M AS (SELECT s.site, s.dir AS sd, s.recv AS sr, s.pkg, s.dynamic, f.fid, f.dir AS fd, f.recv AS fr, f.sig FROM S s JOIN F f ON s.name = f.name AND CASE WHEN f.variadic THEN s.nargs >= f.n_params - 1 ELSE s.nargs = f.n_params END)"""


@query(f"""WITH {_SITES_SQL},
N AS (SELECT site, fid, sig FROM M WHERE dynamic AND fr IS NOT NULL),
T AS (SELECT DISTINCT site, fid, 0 AS tier FROM M WHERE pkg = fd AND fr IS NULL
  UNION SELECT site, fid, 1 FROM M WHERE sd = fd AND sr = fr
  UNION SELECT site, fid, 2 FROM M WHERE sd = fd AND pkg IS NULL AND sr IS NULL AND fr IS NULL
  UNION SELECT site, fid, 3 FROM N WHERE site IN (SELECT site FROM N GROUP BY site HAVING count(DISTINCT fid) <= 5 OR count(DISTINCT sig) = 1)),
B AS (SELECT site, min(tier) AS tier FROM T GROUP BY site)
SELECT T.site, T.fid, CASE WHEN T.tier = 3 THEN 'dispatch' ELSE 'exact' END AS resolution FROM T JOIN B ON T.site = B.site AND T.tier = B.tier""")
def callee_resolution(spark, directory):
    """Call sites resolved by package, own method, same package, then by name among few candidates; arity must fit."""
    p = table(spark, directory, "part")
    functions = p.select(F.col("p_partkey").alias("fid"), F.col("p_brand").alias("dir"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("recv_type"), F.col("p_name").alias("name"), (F.col("p_size") % 4).alias("n_params"), (F.col("p_size") % 5 == 0).alias("variadic"), F.concat("p_name", (F.col("p_size") % 4).cast("string")).alias("signature"))
    sites = p.select(F.col("p_partkey").alias("site"), F.col("p_brand").alias("dir"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("recv_type"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string"))).alias("pkg_dir"), F.col("p_name").alias("name"), (F.col("p_size") % 4).alias("nargs"), (F.col("p_size") % 2 == 0).alias("dynamic"))
    return matching.resolve_callees(sites, functions)


@query("""SELECT DISTINCT p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('ring'), ('bolt'), ('a large blue gear')) c(x) WHERE contains(p_name, x) OR contains(x, p_name))""")
def covered_subtraction(spark, directory):
    """Part names that neither contain nor are in a covered one."""
    names = table(spark, directory, "part").select("p_name").distinct()
    covered = spark.createDataFrame([("ring",), ("bolt",), ("a large blue gear",)], "pattern string")
    return matching.not_covered(names, covered, "p_name", "pattern")


# -- graphs ---------------------------------------------------------------------------------------

_EDGES_SQL = """
G AS (SELECT concat('r', r_regionkey) AS a, concat('n', n_nationkey) AS b, false AS d FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), c_acctbal < 0 FROM customer
UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey), o_orderstatus = 'P' FROM orders
UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), false FROM supplier)"""


def containment(spark, directory) -> DataFrame:
    """Edges region, nation, customer, order and nation, supplier: caller, callee, dispatch, label."""
    t = lambda n: table(spark, directory, n)
    edge = lambda df, a, x, b, y, d: df.select(F.concat(F.lit(a), F.col(x)).alias("caller"), F.concat(F.lit(b), F.col(y)).alias("callee"), d.alias("dispatch"))
    no = F.lit(False)
    edges = edge(t("nation"), "r", "n_regionkey", "n", "n_nationkey", no)
    edges = edges.unionByName(edge(t("customer"), "n", "c_nationkey", "c", "c_custkey", F.col("c_acctbal") < 0))
    edges = edges.unionByName(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey", F.col("o_orderstatus") == "P"))
    edges = edges.unionByName(edge(t("supplier"), "n", "s_nationkey", "s", "s_suppkey", no))
    return edges.withColumn("label", F.col("caller"))




@query(f"""WITH {_EDGES_SQL}
SELECT root, callee, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT a AS root, b AS callee, 1 AS depth FROM G UNION ALL SELECT x.a, y.b, 2 FROM G x JOIN G y ON x.b = y.a) GROUP BY ALL""")
def call_chain(spark, directory):
    """Edges and the edges of their ends."""
    return graph.two_deep(containment(spark, directory), "caller", "callee")


# -- aggregation ------------------------------------------------------------------------------------

@query("""WITH G AS (SELECT c_nationkey, count(*) AS peers, count(*) FILTER (c_acctbal > 0) AS checked_peers FROM customer GROUP BY c_nationkey)
SELECT c_custkey, c.c_nationkey, peers, checked_peers FROM customer c JOIN G USING (c_nationkey) WHERE NOT c_acctbal > 0 AND peers >= 3 AND checked_peers >= 0.5 * peers""")
def peer_outlier(spark, directory):
    """Customers without a positive balance in nations where most have one."""
    members = table(spark, directory, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return aggregates.peer_outliers(members, ["c_nationkey"], F.col("c_acctbal") > 0).select("c_custkey", "c_nationkey", "peers", "checked_peers")


@query("""WITH C AS (SELECT lang, source, count(*) AS chain_count, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY lang, source)
SELECT format('tpl_{:03d}', row_number() OVER (ORDER BY lang, source)) AS template_id, lang, source, chain_count, CAST(shortest AS BIGINT) AS shortest, CAST(longest AS BIGINT) AS longest FROM C""")
def templates_numbered(spark, directory):
    """Documents grouped to numbered templates of (language, source)."""
    docs = table(spark, directory, "documents")
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("chain_count"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    scratch = Scratch(spark)
    numbered = ranks.global_rank(scratch.cut(groups, "groups"), [F.col("lang"), F.col("source")], "place", scratch)
    return numbered.select(F.format_string("tpl_%03d", "place").alias("template_id"), "lang", "source", "chain_count", "shortest", "longest")


@query("""WITH C AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY ALL),
R AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS r, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, o) AS q FROM C)
SELECT p_brand, string_agg(p_name, ',' ORDER BY r) FILTER (r <= 3) AS top, max(p_name) FILTER (q = 1) AS dominant FROM R GROUP BY p_brand""")
def top_values(spark, directory):
    """A1, T4, Q5: a brand's three most frequent part names, and the one that dominates it."""
    p = table(spark, directory, "part").select("p_partkey", "p_brand", "p_name")
    top = aggregates.top_values(p, ["p_brand"], "p_name", 3).select("p_brand", F.array_join("top", ",").alias("top"))
    return top.join(aggregates.most_common(p, ["p_brand"], "p_name", "p_partkey"), "p_brand")


@query("SELECT p_brand AS key, list_sort(list(DISTINCT p_partkey)) AS members FROM part GROUP BY p_brand")
def inverted_index(spark, directory):
    """A2: brand to parts."""
    return aggregates.inverted_index(table(spark, directory, "part"), F.col("p_brand"), "p_partkey")


@query("""WITH C AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), T AS (SELECT sum(n) AS t FROM C)
SELECT event_type, n, round(least(1.0, 2.0 * n / t), 6) AS confidence FROM C, T WHERE CAST(n AS DOUBLE) / t >= 0.1""")
def domain_shares(spark, directory):
    """A5: event types that hold a tenth of all, with twice their share as confidence."""
    return aggregates.shares(table(spark, directory, "events").select("event_type"), "event_type").withColumn("confidence", F.round("confidence", 6))


@query("""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS facet,
CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus END AS value, count(*) AS n, max(l_quantity) AS top, round(avg(l_quantity), 1) AS mean
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def severity_report(spark, directory):
    """A4: counts, top and mean by two facets and overall."""
    return aggregates.summary(table(spark, directory, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""SELECT l_orderkey, l_partkey, CAST(min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS INTEGER) AS severity_rank, max(l_extendedprice) AS confidence, count(*) AS n, list_sort(list(DISTINCT l_suppkey)) AS l_suppkey_set
FROM lineitem GROUP BY l_orderkey, l_partkey""")
def units_grouped(spark, directory):
    """A10: order lines grouped to units by (order, part)."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return aggregates.units(table(spark, directory, "lineitem"), ["l_orderkey", "l_partkey"], rank, "l_extendedprice", ["l_suppkey"])


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3""")
def units_select(spark, directory):
    """A customer's first three orders by priority, then price."""
    orders = table(spark, directory, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return aggregates.best_of_each(orders, ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("""WITH X AS (SELECT *, sum(CAST(o_orderstatus = 'P' AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS c FROM orders),
Y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM X WHERE o_orderstatus <> 'P' OR c <= 1)
SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM Y WHERE place <= 4""")
def topk_one_generic(spark, directory):
    """A customer's four dearest orders, of which one at most is pending."""
    orders = table(spark, directory, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return aggregates.limited_class(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("o_orderstatus") == "P", 4).select("o_custkey", "o_orderkey", "place")


@query("""WITH P AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id, starts_with(url, 'https') AS secure FROM pages)
SELECT host, count(*) AS pages, count(*) FILTER (secure) AS secure, 2 * count(*) FILTER (secure) + 1 AS snapshots FROM P GROUP BY host""")
def repo_inventory(spark, directory):
    """Pages by host, secure ones, and snapshots = 2 secure + 1."""
    p = table(spark, directory, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.startswith("url", F.lit("https")).alias("secure"))
    secure = F.count_if("secure")
    return p.groupBy("host").agg(F.count("*").alias("pages"), secure.alias("secure"), (2 * secure + 1).alias("snapshots"))


@query("""WITH S AS (SELECT p_brand AS v, p_type AS c, 'part' AS s FROM part UNION ALL SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR), 'customer' FROM customer UNION ALL SELECT event_type, CAST(user_id % 3 AS VARCHAR), 'events' FROM events
  UNION ALL SELECT CASE WHEN o_custkey % 4 = 0 THEN 'BUILDING' ELSE 'view' END, o_orderstatus, 'orders' FROM orders),
C AS (SELECT v, c, count(*) AS n FROM S GROUP BY ALL), T AS (SELECT v, s, count(*) AS n FROM S GROUP BY ALL)
SELECT v AS value, (SELECT CAST(sum(n) AS BIGINT) FROM C x WHERE x.v = C.v) AS total, list_sort(list(concat(c, '=', n))) AS categories, (SELECT list_sort(list(concat(s, '=', n))) FROM T WHERE T.v = C.v) AS streams FROM C GROUP BY v""")
def mine_candidates(spark, directory):
    """Values of four streams counted in all, by category and by stream."""
    t = lambda n: table(spark, directory, n)
    streams = [
        ("part", t("part").select(F.col("p_brand").alias("value"), F.col("p_type").alias("c"))),
        ("customer", t("customer").select(F.col("c_mktsegment").alias("value"), F.col("c_nationkey").alias("c"))),
        ("events", t("events").select(F.col("event_type").alias("value"), (F.col("user_id") % 3).alias("c"))),
        ("orders", t("orders").select(F.when(F.col("o_custkey") % 4 == 0, "BUILDING").otherwise("view").alias("value"), F.col("o_orderstatus").alias("c"))),
    ]
    out = aggregates.counters(streams, "value", "c")
    told = lambda c: F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("value", "total", told("by_category").alias("categories"), told("by_stream").alias("streams"))


# -- retrieval ---------------------------------------------------------------------------------------

_TOKENS_SQL = """
B AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS token FROM benchmark),
D AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS token FROM documents)"""


def _tokens(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("token"))


@query(f"""WITH {_TOKENS_SQL}, N AS (SELECT count(DISTINCT doc_id) AS n FROM D)
SELECT token, round(ln((n + 1) / (count(*) + 0.5)), 6) AS idf FROM D, N GROUP BY token, n""")
def token_idf(spark, directory):
    """Inverse document frequencies of the words of all documents."""
    return aggregates.idf(_tokens(table(spark, directory, "documents"), "doc_id"), "doc_id", "token", unique=True).select("token", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_TOKENS_SQL}, W AS (SELECT token, ln((SELECT count(DISTINCT item_id) FROM B) + 1) - ln(count(*) + 0.5) AS idf FROM B GROUP BY token),
S AS (SELECT a.item_id, b.item_id AS other, count(*) AS shared, round(sum(w.idf), 4) AS score FROM B a JOIN B b ON a.token = b.token AND a.item_id <> b.item_id JOIN W w ON w.token = a.token GROUP BY ALL)
SELECT item_id, other, shared, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other) AS r FROM S) WHERE r <= 3""")
def token_idf_topk(spark, directory):
    """The three benchmark items nearest to each by weighted shared words."""
    b = _tokens(table(spark, directory, "benchmark"), "item_id")
    weights = aggregates.idf(b, "item_id", "token", unique=True)
    near = retrieval.top_k(b.withColumnRenamed("item_id", "query"), b.withColumnRenamed("item_id", "item"), weights, 3, Scratch(spark), itself=False)
    return near.select(F.col("query").alias("item_id"), F.col("item").alias("other"), "shared", "score")


@query(f"""WITH {_TOKENS_SQL}, W AS (SELECT token, ln((SELECT count(DISTINCT item_id) FROM B) + 1) - ln(count(*) + 0.5) AS idf FROM B GROUP BY token),
S AS (SELECT d.doc_id, b.item_id, count(*) AS shared, round(sum(w.idf), 4) AS score FROM D d JOIN B b ON d.token = b.token JOIN W w ON w.token = d.token GROUP BY ALL)
SELECT doc_id, item_id, shared, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM S) WHERE r <= 3""")
def documents_topk(spark, directory):
    """The three benchmark items nearest to each document by weighted shared words, frequent ones met last."""
    b = _tokens(table(spark, directory, "benchmark"), "item_id")
    weights = aggregates.idf(b, "item_id", "token", unique=True)
    d = _tokens(table(spark, directory, "documents"), "doc_id").withColumnRenamed("doc_id", "query")
    near = retrieval.top_k(d, b.withColumnRenamed("item_id", "item"), weights, 3, Scratch(spark), common=16)
    return near.select(F.col("query").alias("doc_id"), F.col("item").alias("item_id"), "shared", "score")


# -- scores -------------------------------------------------------------------------------------------

def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_SCORE_SQL = f"""
W AS (SELECT *, 1 - (1 - {_case('C', cvss.CIA_WEIGHT)}) * (1 - {_case('I', cvss.CIA_WEIGHT)}) * (1 - {_case('A', cvss.CIA_WEIGHT)}) AS iss,
  CAST(8.22 AS DOUBLE) * {_case('AV', cvss.AV_WEIGHT)} * {_case('AC', cvss.AC_WEIGHT)} * {_case('concat(PR, S)', cvss.PR_WEIGHT)} * {_case('UI', cvss.UI_WEIGHT)} AS ex FROM V),
X AS (SELECT *, CASE S WHEN 'U' THEN 6.42 * CAST(iss AS DOUBLE) ELSE 7.52 * (CAST(iss AS DOUBLE) - 0.029) - 3.25 * power(CAST(iss AS DOUBLE) - 0.02, 15) END AS im FROM W),
Y AS (SELECT *, CAST(round(least(CASE S WHEN 'U' THEN 1.0 ELSE 1.08 END * (im + CAST(ex AS DOUBLE)), 10) * 100000) AS BIGINT) AS units FROM X),
Z AS (SELECT *, CASE WHEN im <= 0 THEN 0.0 WHEN units % 10000 = 0 THEN units / 100000.0 ELSE (units // 10000 + 1) / 10.0 END AS raw FROM Y)"""
_SEVERITY_SQL = "CASE WHEN raw >= 9 THEN 'critical' WHEN raw >= 7 THEN 'high' WHEN raw >= 4 THEN 'medium' WHEN raw >= 0.1 THEN 'low' ELSE 'none' END AS severity"


def _places() -> dict[str, tuple[int, tuple[str, ...]]]:
    """Of each metric, by how many combinations of those before it a key steps on to its next value."""
    out, step = {}, 1
    for m, values in cvss.VALUES.items():
        out[m] = step, tuple(values)
        step *= len(values)
    return out


@query(f"""WITH V AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f"list_extract([{', '.join(repr(x) for x in v)}], CAST((l_orderkey * 7 + l_partkey) // {n} % {len(v)} AS INTEGER) + 1) AS {m}" for m, (n, v) in _places().items())} FROM lineitem), {_SCORE_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, concat('CVSS:3.1/AV:', AV, '/AC:', AC, '/PR:', PR, '/UI:', UI, '/S:', S, '/C:', C, '/I:', I, '/A:', A) AS vector, CAST(raw AS DOUBLE) AS score, {_SEVERITY_SQL} FROM Z""")
def cvss_enumerate(spark, directory):
    """Order lines given vectors that run through all 2,592, with score and severity."""
    at = F.col("l_orderkey") * 7 + F.col("l_partkey")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.floor(at / n) % len(values) + 1).cast("int"))
    lines = table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct(*[pick(*_places()[m]).alias(m) for m in cvss.METRICS]).alias("m"))
    scored = lines.select("l_orderkey", "l_linenumber", "l_partkey", cvss.vector(F.col("m")).alias("vector"), cvss.base_score(F.col("m")).alias("score"))
    return scored.withColumn("severity", cvss.severity(F.col("score")))


@query(f"""WITH V0 AS (SELECT p_partkey, list_extract([{', '.join(repr(cvss.DEFAULTS.get(c, cvss.OTHER_DEFAULT)) for c in [*seeds.CATEGORIES, 'none_such'])}], CAST(p_size % 13 AS INTEGER) + 1) AS v FROM part),
V AS (SELECT p_partkey, {', '.join(f"regexp_extract(v, '(?:^|/){m}:([A-Z])', 1) AS {m}" for m in cvss.METRICS)} FROM V0), {_SCORE_SQL}
SELECT p_partkey, concat('CVSS:3.1/AV:', AV, '/AC:', AC, '/PR:', PR, '/UI:', UI, '/S:', S, '/C:', C, '/I:', I, '/A:', A) AS vector, CAST(raw AS DOUBLE) AS score, {_SEVERITY_SQL} FROM Z""")
def cvss_defaults(spark, directory):
    """Parts given a category, scored by its default metrics."""
    categories = F.array(*map(F.lit, [*seeds.CATEGORIES, "none_such"]))
    parts = table(spark, directory, "part").select("p_partkey", F.element_at(categories, (F.col("p_size") % 13 + 1).cast("int")).alias("category"))
    none = F.lit(None)
    metrics, _ = cvss.resolved(none.cast("map<string,string>"), F.col("category"), none.cast("array<string>"), none.cast("array<string>"))
    parts = parts.select("p_partkey", metrics.alias("m")).select("p_partkey", cvss.vector(F.col("m")).alias("vector"), cvss.base_score(F.col("m")).alias("score"))
    return parts.withColumn("severity", cvss.severity(F.col("score")))


@query("""WITH X AS (SELECT event_id, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 40 ELSE 0 END AS a, CASE WHEN value > 50 THEN 70 WHEN value > 10 THEN 50 ELSE 20 END AS b, CASE WHEN user_id % 2 = 0 THEN 100 ELSE 30 END AS c FROM events),
Y AS (SELECT event_id, 45 * a + 35 * b + 20 * c AS t FROM X)
SELECT event_id, CAST(t / 10000.0 AS DOUBLE) AS confidence, CASE WHEN t >= 7500 THEN 'confirmed' WHEN t >= 5000 THEN 'likely' ELSE 'tentative' END AS level FROM Y""")
def confidence_score(spark, directory):
    """Three scores weighted, rounded and levelled."""
    a = F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 0.4).otherwise(0.0)
    b = F.when(F.col("value") > 50, 0.7).when(F.col("value") > 10, 0.5).otherwise(0.2)
    c = F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.3)
    out = table(spark, directory, "events").select("event_id", confidence.combined(a, b, c).alias("confidence"))
    return out.withColumn("level", confidence.level(F.col("confidence")))




# -- verdicts, state, texts -------------------------------------------------------------------------




@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50 AS holds FROM events""")
def bug_predicate(spark, directory):
    """Key > 50 on the JSON of each event; null where it isn't a number."""
    e = table(spark, directory, "events")
    return e.select("event_id", scalars.compares(scalars.scalar(F.get_json_object("props", "$.k")), F.lit(">"), F.lit(50.0)).alias("holds"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_extract_fallback(spark, directory):
    """JSON inside a fence and other words, for odd events, parsed by the outermost braces."""
    e = table(spark, directory, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).alias("reply"))
    return e.select("event_id", scalars.json_or_inner(F.col("reply"), "k int")["k"].alias("k"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')""")
def resume_pending(spark, directory):
    """X-a: orders without a finished line; lines returned are to do again."""
    done = table(spark, directory, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").alias("failed"))
    return incremental.pending(table(spark, directory, "orders").select("o_orderkey"), done, ["o_orderkey"], F.col("failed"))


@query("""SELECT o_custkey, o_orderkey, r <= 3 AS within, r AS turn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS r FROM orders)""")
def call_budget(spark, directory):
    """X-c: of each customer's orders in turn, three are within the budget."""
    orders = table(spark, directory, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return incremental.budgeted(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "within", "turn")




@query("""SELECT doc_id, concat(lang, '/f', CAST(doc_id AS VARCHAR), '.go') AS file, CAST(n_chars AS INTEGER) AS start, concat('func ', source) AS header FROM documents""")
def diff_hunks(spark, directory):
    """Hunks of a diff made of each document; equal headers of a file count once."""
    d = table(spark, directory, "documents")
    nl = F.lit("\n")
    text = F.concat(F.lit("+++ b/"), "lang", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".go"), nl, F.lit("@@ -1,2 +"), F.col("n_chars").cast("string"), F.lit(",3 @@ func "), "source", nl, F.lit("+"), F.element_at(F.split("text", "\n"), 1), nl, F.lit("@@ -9 +7 @@ func "), "source")
    return texts.diff_hunks(texts.lines_of(d.select("doc_id", text.alias("text")), ["doc_id"]), ["doc_id"]).select("doc_id", "file", "start", "header")


@query("""WITH L AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(sum(length(line) - length(replace(line, ',', ''))) OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS depth FROM L""")
def running_depth(spark, directory):
    """A running count over the lines of each text, of commas opened as braces."""
    d = table(spark, directory, "documents").select("doc_id", F.translate("text", "{},", "  {").alias("text"))
    return texts.brace_depth(texts.lines_of(d, ["doc_id"]), ["doc_id"]).select("doc_id", "n", "depth")


@query("""WITH L AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
R AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS r FROM L)
SELECT doc_id, count(*) FILTER (r <= 1000) AS kept, max(r) > 1000 AS truncated FROM R GROUP BY doc_id""")
def bounded_read(spark, directory):
    """The leading lines of each text within a cap of characters, and whether more were left out."""
    lines = texts.lines_of(table(spark, directory, "documents"), ["doc_id"])
    return texts.capped(lines, ["doc_id"], 1000).groupBy("doc_id").agg(F.count("n").alias("kept"), F.bool_or("truncated").alias("truncated"))


@query()
def unit_split(spark, directory):
    """V3: texts cut into units of 240 lines and 18,000 characters, before lines that begin a part."""
    lines = texts.lines_of(table(spark, directory, "documents"), ["doc_id"])
    return texts.unit_split(lines, ["doc_id"], F.col("line").rlike("^[A-Z]"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '.', p_name) ELSE p_name END AS qualified, concat(p_type, '/x.go:', CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '.', p_name) ELSE p_name END) AS key, p_name AS bare, p_type AS dir FROM part""")
def function_keys(spark, directory):
    """Keys of functions built and taken apart."""
    p = table(spark, directory, "part").withColumn("recv", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""))
    key = scalars.function_key(F.concat("p_type", F.lit("/x.go")), F.col("recv"), F.col("p_name"))
    return p.select("p_partkey", scalars.qualified(F.col("recv"), F.col("p_name")).alias("qualified"), key.alias("key"), scalars.bare_name(key).alias("bare"), scalars.directory(scalars.file_of(key)).alias("dir"))


@query("""SELECT c_custkey, substr(sha256(concat('["', c_name, '", ', c_nationkey, ', ["', c_mktsegment, '"], null]')), 1, 24) AS finding_id, substr(md5(c_name), 1, 12) AS short FROM customer""")
def content_ids(spark, directory):
    """Identifiers from content."""
    c = table(spark, directory, "customer")
    return c.select("c_custkey", scalars.content_id([scalars.json_text(F.col("c_name")), scalars.json_number(F.col("c_nationkey")), scalars.json_texts(F.array("c_mktsegment")), scalars.json_text(F.lit(None).cast("string"))]).alias("finding_id"), scalars.short_id(F.col("c_name"), "md5").alias("short"))


@query("""SELECT o.o_orderkey, o.o_custkey, c.c_name, coalesce(c.c_mktsegment, 'none') AS segment, CAST(count(l.l_partkey) AS BIGINT) AS lines, list_sort(list_filter(list(DISTINCT l.l_returnflag), lambda x: x IS NOT NULL)) AS flags
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def left_join_summary(spark, directory):
    """Orders with their customer and lines, where they have any, and sets of values."""
    o = table(spark, directory, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, directory, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    lines = table(spark, directory, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_partkey").alias("lines"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    j = null_safe_join(o, c, ["o_custkey"], "left").join(lines, "o_orderkey", "left")
    return j.select("o_orderkey", "o_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


@query("""SELECT user_id AS k FROM events UNION SELECT o_custkey FROM orders""")
def key_union(spark, directory):
    """Keys of either table, once."""
    return table(spark, directory, "events").select(F.col("user_id").alias("k")).union(table(spark, directory, "orders").select("o_custkey")).distinct()


@query("""WITH R AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY """ + ", ".join(_LINE_ORDER) + """) AS r FROM lineitem)
SELECT l_orderkey, l_partkey, l_quantity FROM R WHERE r = 1""")
def ordered_dedup(spark, directory):
    """The first line of each (order, flag), in order."""
    return spans.collapsed(table(spark, directory, "lineitem"), ["l_orderkey", "l_returnflag"], [F.col(c) for c in _LINE_ORDER]).select("l_orderkey", "l_partkey", "l_quantity")


_KINDS_SQL = """
K AS (SELECT user_id, bool_or(event_type = 'error' AND value > 20) AS fact, bool_or(event_type = 'signup' AND value > 20) AS size, bool_or(event_type = 'view' AND value > 20) AS src,
  bool_or(event_type = 'purchase' AND value > 20) AS snk, bool_or(event_type = 'click' AND value > 100) AS entry FROM events GROUP BY user_id)"""


@query(f"WITH {_KINDS_SQL} SELECT user_id, (fact OR (size AND src) OR (src AND snk) OR entry) AS a, (fact OR (size AND src) OR snk OR entry) AS b, (fact OR (size AND src) OR snk OR src OR entry) AS c FROM K")
def taint_gate_levels(spark, directory):
    """users that pass the gate at each level, event types standing for facts, size sinks, sources, sinks and entries."""
    e = table(spark, directory, "events").select(F.col("user_id").alias("function"), "event_type", "value")
    of = lambda t, least=20: e.where((F.col("event_type") == t) & (F.col("value") > least)).select("function")
    points = of("view").select("function", F.lit("source").alias("kind"), F.lit("read").alias("type")).unionByName(of("purchase").select("function", F.lit("sink").alias("kind"), F.lit("file_read").alias("type")))
    users = e.select("function").distinct()
    out = users
    for level in "ABC":
        passed = gates.taint_gate(users, of("error"), of("signup"), points, of("click", 100), level, True).withColumn(level.lower(), F.lit(True))
        out = out.join(passed, "function", "left")
    return out.select(F.col("function").alias("user_id"), *[F.coalesce(c, F.lit(False)).alias(c) for c in "abc"])


@query("""WITH R AS (SELECT l_partkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS INTEGER) AS place, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey, l_orderkey, place, n > 20 AS truncated FROM R WHERE place <= 20""")
def bounded_neighbours(spark, directory):
    """The first twenty orders of each part, and whether there are more (the cap is the report's)."""
    edges = table(spark, directory, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return gates.neighbours(edges, "l_partkey", "l_orderkey", ["l_linenumber", "l_quantity", "l_extendedprice"], 20).select("l_partkey", "l_orderkey", "place", "truncated")


@query("""WITH C AS (SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS INTEGER) AS batch FROM orders) SELECT * FROM C""")
def work_batches(spark, directory):
    """Batching of 2.15: a customer's orders in batches of four."""
    return gates.batches(table(spark, directory, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)


@query("""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'critical' WHEN p_type = 'MEDIUM' THEN 'high' ELSE 'low' END AS severity FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'MEDIUM') AND p_size >= 10 AND p_brand <> 'Brand#1'""")
def finding_filters(spark, directory):
    """parts as findings of a severity and confidence, filtered."""
    severity = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "critical").when(F.col("p_type") == "MEDIUM", "high").otherwise("low")
    p = table(spark, directory, "part").select("p_partkey", severity.alias("severity"), F.col("p_size").alias("confidence"), F.col("p_brand").alias("category"))
    return gates.filtered_findings(p, floor="medium", least_confidence=10).where("category <> 'Brand#1'").select("p_partkey", "severity")


# -- rules ------------------------------------------------------------------------------------------


def _by_status(o: str, f: str) -> Column:
    return F.when(F.col("status") == "O", o).otherwise(f)


def _facts(lines: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Lines of a kind as facts of functions: function, line, ord and the given columns."""
    return lines.where(F.col("kind") == kind).select(F.col("grp").cast("string").alias("function"), F.col("pos").alias("line"), F.col("pos").alias("ord"), *[v.alias(n) for n, v in columns.items()])


@query(f"""WITH {_LINES_SQL},
P AS (SELECT s.grp, CASE k.status WHEN 'O' THEN 'path_validation' ELSE 'input_sanitization' END AS category, s.pos AS source_line, k.pos AS sink_line
  FROM L s JOIN L k ON s.grp = k.grp WHERE s.kind = 'R' AND k.kind = 'N' AND s.pos <> k.pos AND NOT (s.pos - k.pos BETWEEN 1 AND 2)
  AND NOT EXISTS (SELECT 1 FROM L c WHERE c.grp = s.grp AND c.kind = 'A' AND c.status = k.status AND c.pos > least(s.pos, k.pos) AND c.pos < greatest(s.pos, k.pos)))
SELECT CAST(grp AS VARCHAR) AS function, category, min(source_line) AS source_line, sink_line FROM P GROUP BY ALL""")
def rule_spans(spark, directory):
    """R-v2, F9, J5: the span rule without generic sinks over order lines: R as sources, N as sinks, A as checks."""
    lines = order_lines(spark, directory)
    sources = _facts(lines, "R", type=_by_status("http_request", "read"), desc=F.lit(""))
    sinks = _facts(lines, "N", type=_by_status("file_write", "sql_query"), desc=F.lit(""))
    checks = _facts(lines, "A", category=_by_status("path_validation", "input_sanitization"))
    known = sources.select("function").unionByName(sinks.select("function"))
    out = rules.span_findings(sources.drop("ord"), sinks.drop("ord"), checks, known, rules.Rules.of("v2,F3"))
    return out.select("function", "category", "source_line", "sink_line")


@query(f"""WITH {_LINES_SQL}, S AS (SELECT grp, min(pos) AS lo FROM L WHERE kind = 'R' GROUP BY grp)
SELECT DISTINCT CAST(k.grp AS VARCHAR) AS function, CASE k.status WHEN 'O' THEN 'resource_limit' ELSE 'bounds_check' END AS category, s.lo AS source_line, k.pos AS sink_line
FROM L k JOIN S s ON s.grp = k.grp AND s.lo < k.pos WHERE k.kind = 'N' AND NOT EXISTS (SELECT 1 FROM L c WHERE c.grp = k.grp AND c.kind = 'A' AND c.part % 3 = k.part % 3 AND c.pos >= s.lo AND c.pos < k.pos)""")
def rule_sizes(spark, directory):
    """Sizes after an external source without a range check of the same variable from the source on."""
    lines = order_lines(spark, directory)
    variable = (F.col("part") % 3).cast("string")
    sources = _facts(lines, "R", type=F.lit("http_request"), desc=F.lit(""))
    sizes = _facts(lines, "N", type=_by_status("alloc_size", "index_access"), var=variable, pattern=F.lit(""))
    ranges = _facts(lines, "A", var=variable)
    none = ranges.where("false").select("function", "line", F.lit("").alias("category"))
    return rules.size_findings(sources, none, sizes, ranges).select("function", "category", "source_line", "sink_line")


@query(f"""WITH {_LINES_SQL},
T AS (SELECT k.grp, CASE k.status WHEN 'O' THEN 'path_validation' ELSE 'resource_limit' END AS category, k.pos AS sink_line, CASE k.status WHEN 'O' THEN 'R2' ELSE 'R4' END AS rule_id FROM L k WHERE k.kind = 'N' AND k.pos > 1
  AND (k.status = 'F' OR NOT EXISTS (SELECT 1 FROM L c WHERE c.grp = k.grp AND c.kind = 'A' AND c.pos >= 1 AND c.pos < k.pos)))
SELECT CAST(grp AS VARCHAR) AS function, category, min(sink_line) AS sink_line, rule_id FROM T GROUP BY ALL""")
def rule_taint(spark, directory):
    """Tainted sinks, the earliest of each category without a check; reads know no check but their reader's bound."""
    lines = order_lines(spark, directory)
    facts = _facts(lines.where("pos > 1"), "N", sink_line=F.col("pos"), sink_type=_by_status("file_read", "unbounded_read"), sink_desc=F.lit(""), source_line=F.lit(1), source_desc=F.lit(""), provenance=F.lit("net_entry"), path=F.array().cast("array<string>")).drop("line", "ord")
    checks = _facts(lines, "A", category=F.lit("path_validation"))
    return rules.taint_findings(facts, checks, None, rules.Rules.of("R2,R4")).select("function", "category", "sink_line", "rule_id")


@query("""WITH M AS (SELECT c_nationkey, c_custkey, c_mktsegment, c_acctbal FROM customer),
G AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 2000) AS k FROM M GROUP BY ALL)
SELECT CAST(c_custkey AS VARCHAR) AS function, CAST(k AS INTEGER) AS peers_present FROM M JOIN G USING (c_nationkey, c_mktsegment) WHERE NOT c_acctbal > 2000 AND n >= 3 AND k >= 0.5 * n""")
def rule_peers(spark, directory):
    """Customers of a nation and segment that lack what most have."""
    c = table(spark, directory, "customer").select(F.col("c_custkey").cast("string").alias("function"), "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 2000).alias("checked"), F.lit(1).alias("access_line"), F.lit("").alias("access_text"))
    return rules.peer_findings(c, ["c_nationkey", "c_mktsegment"]).select("function", "peers_present")


@query("""WITH U AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'purchase') AS m, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id)
SELECT user_id AS unit_id, CASE WHEN c % 7 = 6 THEN 'timeout' WHEN c % 7 = 5 THEN 'markers_missing' WHEN c % 7 = 4 THEN 'blocked_by_known_guard' WHEN c % 7 = 3 THEN 'malicious_not_reached'
  WHEN b = m THEN 'arms_indistinguishable' WHEN m > 13 AND b <= 13 THEN 'bug_if_holds_on_malicious_only' WHEN m > 13 THEN 'benign_also_bug' ELSE 'no_bug_observed' END AS rule FROM U""")
def verdict_markers(spark, directory):
    """Verdicts parsed from the printed markers of runs, one made for each user."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    u = table(spark, directory, "events").groupBy(F.col("user_id").alias("unit_id")).agg(n("view").alias("b"), n("purchase").alias("m"), n("click").alias("c"))
    case = F.col("c") % 7
    stopped = F.when(case == 4, "REACHED=no BLOCKED_AT=f.go:5").when(case == 3, "REACHED=no BLOCKED_AT=f.go:9").when(case == 2, "REACHED=no BLOCKED_AT=f.go:25").otherwise("REACHED=yes BLOCKED_AT=none")
    output = F.concat_ws("\n", F.lit("=== RUN"), F.lit("  ARM=benign REACHED=yes BLOCKED_AT=none"), F.concat(F.lit("ARM=benign RESULT elapsed_ms=3 n="), "b"), F.when(case != 5, F.concat(F.lit("ARM=malicious "), stopped)), F.concat(F.lit("ARM=malicious RESULT path=/tmp/x n="), "m"), F.lit("PASS"))
    runs = u.select("unit_id", output.alias("output"), (case == 6).alias("timed_out"), F.lit(False).alias("build_failed"))
    specs = u.select("unit_id", F.struct(F.lit("n").alias("key"), F.lit(">").alias("op"), F.lit("13").alias("value")).alias("bug_if"))
    guards = u.select("unit_id", F.lit("f.go:5").alias("location"))
    return judge.judged(runs, specs, guards, u.select("unit_id", F.lit(20).alias("line"))).select("unit_id", "rule")


@query("""WITH R AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS round FROM orders),
T AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY round, o_orderstatus = 'P' DESC, o_orderstatus, o_orderkey) AS INTEGER) AS turn FROM R)
SELECT o_orderkey, CAST(round AS INTEGER) AS round, turn, CASE WHEN turn <= 5 THEN 'done' ELSE 'pending' END AS status FROM T""")
def schedule_round_robin(spark, directory):
    """V4: a customer's orders by status groups in turn, pending ones first, five within the budget of calls."""
    work = table(spark, directory, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("grp"), F.lit(0).alias("group_ord"), F.col("o_orderkey").alias("item"), F.lit(0).alias("item_ord"), (F.col("o_orderstatus") == "P").alias("semantic"), F.lit(False).alias("representative"))
    return verify.schedule(work, 5).select(F.col("item").alias("o_orderkey"), "round", "turn", "status")


@query("""WITH L AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
W AS (SELECT doc_id, n, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS text FROM L)
SELECT doc_id, CAST(n AS INTEGER) AS at, sha256(text) AS text FROM W WHERE n % 3 = 0 UNION ALL SELECT doc_id, CAST(n AS INTEGER), sha256(text) FROM W WHERE n = 3""")
def line_windows(spark, directory):
    """M5: the lines around every third of each text, one before and two after; the first of them is asked for twice."""
    lines = texts.lines_of(table(spark, directory, "documents"), ["doc_id"])
    points = lines.where("n % 3 = 0").unionByName(lines.where("n = 3")).select("doc_id", F.col("n").alias("at"))
    return texts.windows_around(lines, points, ["doc_id"], "at", 1, 2).select("doc_id", "at", F.sha2("text", 256).alias("text"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'missing metrics' WHEN 2 THEN 'bad prefix' WHEN 3 THEN 'illegal value' WHEN 4 THEN 'duplicate metric' ELSE 'unknown metric' END AS error FROM customer""")
def cvss_faults(spark, directory):
    """Vectors with each kind of fault, parsed."""
    v = F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")
    case = F.col("c_custkey") % 6
    text = F.when(case == 0, v).when(case == 1, F.regexp_replace(v, "/A:H", "")).when(case == 2, F.regexp_replace(v, "3.1", "4.0")).when(case == 3, F.regexp_replace(v, "UI:N", "UI:Q")).when(case == 4, F.concat(v, F.lit("/AV:L"))).otherwise(F.concat(v, F.lit("/ZZ:L")))
    c = table(spark, directory, "customer").select("c_custkey", text.alias("v"))
    return c.select("c_custkey", cvss.parse_vector(F.col("v"))[1].alias("error"))


from quern.plans import fact_queries, flow_queries, report_queries  # noqa: E402,F401  register their queries here

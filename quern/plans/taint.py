"""Inter-procedural taint: an and-or fixpoint over tables of calls, for any number of repositories at once.

External data reaches parameters, returned values and call results along calls.  A parameter takes
what any call offers; the result of a call resolved by name alone needs a claim from *every*
candidate.  Each step costs a hop, and no claim goes beyond ``max_hops``.

*States.*  A claim has an origin (net, wire, io, cb, llm: the less, the stronger), tells whether a call was
resolved by name alone, and counts hops.  A value keeps the least hops for *each* pair of origin and
dispatch, at most ten numbers, as a weaker claim that is nearer may go on where a stronger one is
at its cap.  So more input never loses a finding, and no order of functions matters.  Of a call by
name, a claim of one candidate holds if every other has one at least as strong (by origin, dispatch, hops).

*Asks.*  Calls that ask for the same name from the same place with as many arguments have the same candidates, so
callees are found once for each such ask.  A call passes its arguments to its ask, and the ask to its
candidates: calls times candidates are never written out.  What an ask's candidates return is likewise gathered
once, by the parameters that they return, and met by its calls.  Only results that some root names are kept.

*Rounds.*  The loop carries numbers alone: (f, v, cell, hops), a function and its value.  Each round joins what changed to the
arguments passed, and computes the results of calls anew; it is cut to a table in the shared folder and
ends when nothing changes.  Values that only pass claims on without a hop (returned values, candidates'
claims) are folded in.  Roots that are external in themselves are no rows to join to:
they offer once, before the first round.  Paths are built afterwards, from hop to hop, for the claims that stand, where asked for.

``functions``: repo, file, function, line, params (index, name, type, type_pkg, type_base, first_use),
call_sites, ret_calls, callees, callback_refs (line, name, pkg, recv, nargs, args: index, roots), return_roots,
ret_params, variadic, recv_type, taint_sinks (line, type, pattern, roots); ``flows_of`` reads them from JSON.
``modules``: repo, module, base.  ``wire_types``: repo, dir, type_base.  ``triaged``: repo, function (file:function), index.

Defined cases: null arrays are empty; a root that is null, unknown or names no value carries nothing; rows
that repeat count once, but for sinks, which come out as often as they are written in their function;
functions of one repo, file and name are one in calls; of claims of one rank a parameter's comes first, then the smallest
index and path; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import matching
from quern.scratch import Scratch

#: Origins by root, from the strongest, their names, and roots that carry no data.
ROOT_ORIGIN = {"entry": 0, "src": 0, "wire": 1, "io": 2, "cb": 3}
ORIGIN_NAMES = ("net", "wire", "io", "cb", "llm")
NO_DATA = ("lim", "body", "decomp", "resp")
NOT_CALLBACK_DATA = ("context.Context", "http.ResponseWriter")
MAX_HOPS, DISPATCH = 8, 5

_ARG = "struct<index: int, roots: array<string>>"
_SITE = f"struct<line: int, name: string, pkg: string, recv: string, nargs: int, args: array<{_ARG}>>"
FLOW = (
    "file string, function string, line int, params array<struct<index: int, name: string, type: string, type_pkg: string, type_base: string, first_use: int>>, "
    f"call_sites array<{_SITE}>, ret_calls array<{_SITE}>, callees array<{_SITE}>, callback_refs array<{_SITE}>, return_roots array<string>, ret_params array<int>, "
    "variadic boolean, recv_type string, taint_sinks array<struct<line: int, type: string, pattern: string, roots: array<string>>>"
)
SITES = ("call_sites", "ret_calls", "callees", "callback_refs")
#: A claim's cell (origin and dispatch) and its hops as one number that sorts by strength.
_HOP_BITS = 16


def flows_of(rows: DataFrame, facts: str = "facts") -> DataFrame:
    """``functions`` from repo and a column of JSON, one function each."""
    return rows.select("repo", F.from_json(facts, FLOW).alias("f")).select("repo", "f.*")


def _slot(kind: Column | int, number: Column) -> Column:
    """A function's value as a number: of a parameter (0), a call's result (1), or that result as its callers see it (2)."""
    return number.cast("long") * 3 + kind


def _folder(path: str) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/", 1)).otherwise("")


def package_folders(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """repo, pkg and dir of the packages (repo, pkg) that lie in a module of their repo, by the longest module path."""
    scoped = lambda c: F.concat_ws("/", F.translate("repo", "/", "\x01"), c)
    known = modules.select(scoped("module").alias("__module"), F.col("base").alias("__base"))
    met = matching.longest_prefix(packages.where("pkg <> ''").distinct().withColumn("__pkg", scoped("pkg")), known, "__pkg", "__module")
    rest = F.expr("substr(__pkg, length(__module) + 2)")
    return met.select("repo", "pkg", F.array_join(F.filter(F.array("__base", rest), lambda x: x != ""), "/").alias("dir"))


#: What decides a call's candidates.
_ASK = ("repo", "dir", "receiver", "pkg", "name", "nargs", "any_nargs", "dynamic")


class Calls:
    """Functions (``f`` numbers them), what their calls ask for (``asks``), and the functions that each ask may reach (``members``)."""

    def __init__(self, functions: DataFrame, modules: DataFrame, scratch: Scratch, dispatch: bool = True):
        named = functions.withColumn("key", F.concat_ws(":", "file", "function")).withColumn("dir", _folder("file"))
        numbered = named.withColumn("bare", F.regexp_extract("function", r"([^.]*)$", 1)).withColumn("f", F.monotonically_increasing_id())
        self.functions = scratch.cut(numbered, "functions")
        doubles = self.functions.groupBy("repo", "key").agg(F.min("f").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        if not doubles.isEmpty():  # functions of one repo, file and name are one
            self.functions = scratch.cut(self.functions.join(doubles, ["repo", "key"], "left").withColumn("f", F.coalesce("first", "f")).drop("first"), "functions")
        self.dispatch, self.modules = dispatch, modules
        types = F.transform(F.coalesce("params", F.array()), lambda p: F.coalesce(p["type"], F.lit("")))
        known = self.functions.select("repo", F.col("f").alias("fid"), "dir", F.when(F.col("recv_type") != "", F.col("recv_type")).alias("recv_type"), F.col("bare").alias("name"), F.size(types).alias("n_params"), F.coalesce("variadic", F.lit(False)).alias("variadic"), F.to_json(types).alias("signature"))
        known, each = scratch.cut(known, "known"), None
        for kind in SITES:
            some = self.sites(kind).select(*_ASK)
            each = some if each is None else each.unionByName(some)
        asks = scratch.cut(each.where("name is not null").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
        folders = package_folders(asks.select("repo", "pkg"), modules).withColumnRenamed("dir", "pkg_dir")
        placed = asks.where("pkg = ''").withColumn("pkg_dir", F.lit(None).cast("string")).unionByName(asks.where("pkg <> ''").join(folders, ["repo", "pkg"]))
        asked = placed.select("repo", F.col("ask").alias("site"), "dir", F.nullif("receiver", F.lit("")).alias("recv_type"), "pkg_dir", "name", F.when(~F.col("any_nargs"), F.col("nargs")).alias("nargs"), "dynamic")
        found = matching.resolve_callees(asked, known, DISPATCH, scope=["repo"])
        self.members = scratch.cut(found.select(F.col("site").alias("ask"), "fid", (F.col("resolution") == "dispatch").alias("by_name")), "members")
        self.asks = scratch.cut(asks.join(self.members.groupBy("ask").agg(F.max("by_name").alias("by_name")), "ask"), "asks")

    def sites(self, kind: str) -> DataFrame:
        """Call sites of a kind, with what they ask for."""
        pkg, recv = F.coalesce("site.pkg", F.lit("")), F.coalesce("site.recv", F.lit(""))
        own = (recv == "self") & (F.col("recv_type") != "") & (pkg == "")
        receiver = F.when(own, F.col("recv_type")).when((recv != "") & (pkg == ""), "\x01unknown").otherwise("")
        return self.functions.select("repo", "f", "key", "dir", "bare", "recv_type", F.explode(kind).alias("site")).select(
            "repo", "f", "key", "bare", F.when(pkg == "", F.col("dir")).otherwise("").alias("dir"), receiver.alias("receiver"), pkg.alias("pkg"), "site.name",
            F.coalesce("site.nargs", F.lit(0)).alias("nargs") if kind != "callback_refs" else F.lit(0).alias("nargs"), F.lit(kind == "callback_refs").alias("any_nargs"),  # whoever calls back passes what fits
            (F.lit(self.dispatch) & (pkg == "") & (recv != "")).alias("dynamic"), "site.line", "site.args")

    def asking(self, sites: DataFrame) -> DataFrame:
        """Sites that reach a function, with their ask and whether it is by name."""
        return sites.join(self.asks, list(_ASK)).drop("repo", "dir", "receiver", "pkg", "nargs", "any_nargs", "dynamic")

    def targets(self, kind: str) -> DataFrame:
        """by, line, f and by_name: functions that sites of a kind may reach."""
        return self.asking(self.sites(kind)).select("ask", F.col("key").alias("by"), "line").join(self.members, "ask").select("by", "line", F.col("fid").alias("f"), "by_name")

    def keys(self) -> DataFrame:
        return self.functions.select("f", "key").distinct()


def _rooted(rows: DataFrame, roots: str, own: Column) -> DataFrame:
    """Rows with each root's ``origin``, or the value ``v`` of function f that it is; ``own``: do the function's parameters count?"""
    each = rows.withColumn("root", F.explode(F.array_distinct(roots)))
    of = F.lit(None)
    for root, number in ROOT_ORIGIN.items():
        of = F.when(F.col("root") == root, number).otherwise(of)
    number = F.expr("try_cast(regexp_extract(root, '^(?:param|call):(0|[1-9][0-9]*)$', 1) as int)")
    v = F.when(F.startswith("root", F.lit("param:")), F.when(own, _slot(0, number))).otherwise(_slot(F.when(own, 1).otherwise(2), number))
    return each.withColumn("origin", of.cast("int")).withColumn("v", F.when(F.col("origin").isNull(), v)).where("origin is not null or v is not null")


def _results_read(functions: DataFrame, returned: DataFrame, passed: DataFrame) -> DataFrame:
    """f, line and own: the results of calls that some root of their function names, read in it or (not own) in its callers.

    ``returned``: f and args of calls whose results are; ``passed``: f and v, what other calls pass.
    """
    roots = lambda rows, of: rows.select("f", F.explode(of).alias("root")).where(F.startswith("root", F.lit("call:"))).distinct()
    in_callers = roots(functions, "return_roots").unionByName(both := roots(returned.select("f", F.explode("args.roots").alias("roots")), "roots")).withColumn("own", F.lit(False))
    in_it = roots(functions.select("f", F.explode("taint_sinks.roots").alias("roots")), "roots").unionByName(both).withColumn("own", F.lit(True))
    named = in_callers.unionByName(in_it).select("f", "own", F.expr("try_cast(substr(root, 6) as int)").alias("line")).where("line is not null")
    return named.unionByName(passed.where("v % 3 = 1").select("f", F.lit(True).alias("own"), F.expr("cast(v div 3 as int)").alias("line"))).distinct()


class Edges:
    """Who passes a claim to whom.

    ``passed``: f and v (or origin), ask, index, by_name, line; what calls pass to their ask's candidates.
    ``direct``: f and v (or origin), to_f, to_v, by_name, line, result: what is passed to a value itself.
    ``results``: group, f, v, line, ask, by_name, of: results of calls; a group of a call by name needs ``of`` classes.
    ``made``: ask, claim, class, f and v (or origin): what candidates return of their own making, read in them.
    ``given``: group, ask, index, f and v (or origin): what calls by name give for parameters that candidates return.
    ``classes``, ``members_of``: of an ask's candidates, those that return the same parameters: ask, class, n; ask, class, index.
    """

    def __init__(self, calls: Calls, scratch: Scratch):
        sites = calls.asking(calls.sites("call_sites")).withColumn("arg", F.explode("args"))
        own = F.col("name") == F.col("bare")  # only such a call can reach the function it is in, which passes nothing to itself
        rows = _rooted(sites.select("f", "line", "ask", "by_name", own.alias("own_name"), "arg.index", "arg.roots"), "roots", F.lit(True)).where("index is not null")
        rows = scratch.cut(rows.groupBy("f", "v", "origin", "ask", "index", "by_name", "own_name").agg(F.min(F.col("line").cast("string")).alias("line")), "passed")
        self.passed = rows.where("not own_name").drop("own_name")
        recursive = rows.where("own_name").join(calls.members.select("ask", "fid"), "ask").where("fid <> f")
        recursive = recursive.select("f", "v", "origin", F.col("fid").alias("to_f"), _slot(0, F.col("index")).alias("to_v"), "by_name", "line", F.lit(None).cast("long").alias("ask"))

        read = scratch.cut(_results_read(calls.functions, calls.sites("ret_calls"), rows), "read")
        results = calls.asking(calls.sites("ret_calls").join(read, ["f", "line"])).withColumn("group", F.monotonically_increasing_id())
        results = scratch.cut(results.select("group", "f", _slot(F.when(F.col("own"), 1).otherwise(2), F.col("line")).alias("v"), "own", "line", "ask", "by_name", "args"), "results")
        asks = results.select("ask").distinct()
        returning = calls.functions.select(F.col("f").alias("fid"), "return_roots", F.array_sort(F.array_distinct(F.coalesce("ret_params", F.array().cast("array<int>")))).alias("ret_params")).dropDuplicates(["fid"])
        met = calls.members.join(asks, "ask", "left_semi").join(returning, "fid")
        met = scratch.cut(met.select("ask", "fid", "return_roots", "ret_params", F.array_join(F.col("ret_params").cast("array<string>"), ",").alias("class")), "returning")
        self.made = scratch.cut(_rooted(met.select("ask", F.col("fid").alias("claim"), "class", F.col("fid").alias("f"), "return_roots"), "return_roots", F.lit(False)).select("ask", "claim", "class", "f", "v", "origin"), "made")
        self.classes = scratch.cut(met.groupBy("ask", "class").agg(F.count_distinct("fid").alias("n"), F.max("ret_params").alias("ret_params")), "classes")
        self.members_of = self.classes.select("ask", "class", F.explode("ret_params").alias("index"))
        taken = self.members_of.select("ask", "index").distinct()
        args = results.withColumn("arg", F.explode("args")).select("group", "f", F.col("v").alias("to_v"), "own", "line", "ask", "by_name", "arg.index", "arg.roots")
        given = _rooted(args.join(taken, ["ask", "index"]), "roots", F.col("own"))
        given = scratch.cut(given.select("group", "ask", "index", "f", "v", "origin", F.col("f").alias("to_f"), "to_v", "by_name", F.col("line").cast("string").alias("line")), "given")
        self.results = results.drop("own", "args").join(self.classes.groupBy("ask").agg(F.count(F.lit(1)).alias("of")), "ask")
        self.results = scratch.cut(self.results, "groups")
        self.given = given.where("by_name").select("group", "ask", "index", "f", "v", "origin")
        through = given.where("not by_name").select("f", "v", "origin", "to_f", "to_v", "by_name", "line", "ask")
        self.direct = scratch.cut(recursive.unionByName(through).distinct(), "direct")
        self.members = calls.members.select("ask", "fid")


def seeds_of(calls: Calls, wire_types: DataFrame, triaged: DataFrame) -> DataFrame:
    """f, v, origin, dispatch and why: parameters that are external before any call is looked at."""
    value = [F.col("f"), _slot(0, F.col("index")).alias("v")]
    parameters = calls.functions.select("repo", "f", "key", "dir", F.explode("params").alias("p")).select("repo", "f", "key", "dir", "p.*")
    known = calls.functions.select("repo", "key", "f").distinct()
    judged = triaged.select("repo", F.col("function").alias("key"), "index").join(known, ["repo", "key"])
    judged = judged.select(*value, F.lit(4).alias("origin"), F.lit(False).alias("dispatch"), F.format_string("%s: parameter %s judged external by entry triage", "key", "index").alias("why"))
    given = parameters.where("name <> '_'")
    data = given.where(F.col("type").isNull() | ~F.col("type").isin(*NOT_CALLBACK_DATA))
    called_back = calls.targets("callback_refs").join(data, "f").select(*value, F.lit(3).alias("origin"), F.col("by_name").alias("dispatch"), F.format_string("%s@L%s hands %s to other code", "by", "line", "key").alias("why"))
    free = given.join(calls.targets("callees").select("f").distinct(), "f", "left_anti").withColumn("pkg", F.coalesce("type_pkg", F.lit("")))
    folders = package_folders(free.select("repo", "pkg"), calls.modules).withColumnRenamed("dir", "pkg_dir")
    placed = free.where("pkg = ''").unionByName(free.where("pkg <> ''").join(folders, ["repo", "pkg"]).withColumn("dir", F.col("pkg_dir")).drop("pkg_dir"))
    wired = placed.join(wire_types.select("repo", "dir", "type_base").distinct(), ["repo", "dir", "type_base"])
    wired = wired.select(*value, F.lit(1).alias("origin"), F.lit(False).alias("dispatch"), F.format_string("%s: %s is %s (tagged struct)", "key", "name", "type").alias("why"))
    return judged.unionByName(called_back).unionByName(wired).where("v is not null")


def _strength(cell: str = "cell", hops: str = "hops") -> Column:
    return F.col(cell) * _HOP_BITS + F.col(hops)


_VALUE = ["f", "v"]


def _constant(rows: DataFrame, *keep: str) -> DataFrame:
    """Claims of roots that are external in themselves."""
    return rows.where("origin is not null").select(*keep, (F.col("origin") * 2).alias("cell"), F.lit(0).alias("hops"))


def _inputs(edges: Edges, states: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ask, claim, class, cell, hops: what candidates return; group, ask, index, cell, hops: what calls by name give), the least hops of each."""

    def of(rows: DataFrame, name: str, *keep: str) -> DataFrame:
        met = rows.join(states, _VALUE).select(*keep, "cell", "hops").unionByName(_constant(rows, *keep))
        return scratch.cut(met.groupBy(*keep, "cell").agg(F.min("hops").alias("hops")), name)

    return of(edges.made, "returned", "ask", "claim", "class"), of(edges.given, "given", "group", "ask", "index")


def _all_agree(edges: Edges, returned: DataFrame, given: DataFrame) -> DataFrame:
    """group, least: how strong a claim must not be stronger than, for results by name whose candidates all have one.

    A candidate's strongest claim is the better of what it returns of its own and of what the call gives for the parameters it
    returns; so the candidates of a class differ in the first alone, and the weakest of these stands for them.
    """
    groups = edges.results.where("by_name").select("group", "ask", "of")
    best = returned.groupBy("ask", "class", "claim").agg(F.min(_strength()).alias("best"))
    worst = best.groupBy("ask", "class").agg(F.count(F.lit(1)).alias("have"), F.max("best").alias("best"))
    worst = worst.join(edges.classes, ["ask", "class"]).where("have = n").select("ask", "class", "best")
    own = groups.join(worst, "ask").select("group", "class", "best")
    through = given.groupBy("group", "ask", "index").agg(F.min(_strength()).alias("best")).join(edges.members_of, ["ask", "index"]).select("group", "class", "best")
    each = own.unionByName(through).groupBy("group", "class").agg(F.min("best").alias("best"))
    return each.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("least")).join(groups, "group").where("n = of").select("group", "least")


def fixpoint(edges: Edges, seeds: DataFrame, max_hops: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(states: f, v, cell, hops; bars: group, least).  ``cell`` is twice the origin, and one more after a call by name."""
    near = F.col("hops") < max_hops
    on = [F.col("cell").bitwiseOR(F.col("by_name").cast("int")).alias("cell"), (F.col("hops") + 1).alias("hops")]
    least = lambda df, *by: df.groupBy(*by, "cell").agg(F.min("hops").alias("hops"))
    state = [*_VALUE, "cell", "hops"]

    def offers(passed: DataFrame, direct: DataFrame) -> DataFrame:
        to_ask = least(passed.where(near).select("ask", "index", *on), "ask", "index")
        to_members = to_ask.join(edges.members, "ask").select(F.col("fid").alias("f"), _slot(0, F.col("index")).alias("v"), "cell", "hops")
        return to_members.unionByName(direct.where(near).select(F.col("to_f").alias("f"), F.col("to_v").alias("v"), *on))

    def of_results(states: DataFrame) -> DataFrame:
        returned, given = _inputs(edges, states, scratch)
        front = least(returned, "ask")
        exact = edges.results.where("not by_name").join(front, "ask").select("f", "v", "by_name", "cell", "hops")
        bars = scratch.cut(_all_agree(edges, returned, given), "bars")
        named = edges.results.where("by_name").join(bars, "group").select("group", "ask", "f", "v", "by_name", "least")
        held = named.join(front, "ask").select("f", "v", "by_name", "least", "cell", "hops").unionByName(named.drop("ask").join(given, "group").select("f", "v", "by_name", "least", "cell", "hops"))
        held = held.where(_strength() >= F.col("least")).drop("least")
        return exact.unionByName(held).where(near).select(*_VALUE, *on), bars

    seeded = seeds.select(*_VALUE, (F.col("origin") * 2 + F.col("dispatch").cast("int")).alias("cell"), F.lit(0).alias("hops"))
    constant = offers(_constant(edges.passed, "ask", "index", "by_name"), _constant(edges.direct, "to_f", "to_v", "by_name"))
    states = changed = scratch.cut(least(seeded.unionByName(constant), *_VALUE), "taint")
    passed, direct = (e.where("v is not null").drop("origin", "line") for e in (edges.passed, edges.direct))
    while True:
        results, bars = of_results(states)
        offered = least(offers(passed.join(changed, _VALUE), direct.join(changed, _VALUE)).unionByName(results), *_VALUE).withColumnRenamed("hops", "offered")
        merged = states.join(offered, [*_VALUE, "cell"], "full")
        better = F.col("offered").isNotNull() & (F.col("hops").isNull() | (F.col("offered") < F.col("hops")))
        after = scratch.cut(merged.select(*_VALUE, "cell", F.when(better, F.col("offered")).otherwise(F.col("hops")).alias("hops"), better.alias("changed")), "taint")
        states, changed = after.select(*state), after.where("changed").select(*state)
        if changed.isEmpty():
            return states, bars


def paths_of(calls: Calls, edges: Edges, seeds: DataFrame, states: DataFrame, bars: DataFrame, scratch: Scratch) -> DataFrame:
    """states with ``path``: the least of their shortest derivations, hop by hop."""
    last = states.agg(F.max("hops")).first()[0]
    if last is None:
        return states.withColumn("path", F.array().cast("array<string>"))
    keys = calls.keys()
    first = edges.members.join(keys.withColumnRenamed("f", "fid"), "fid").groupBy("ask").agg(F.min("key").alias("first"))
    at, after = F.format_string("%s@L%s", "key", "line"), F.format_string("%s@L%s ← %s", "key", "line", "first")
    passed = scratch.cut(edges.passed.join(keys, "f").select("f", "v", "origin", "ask", "index", "by_name", at.alias("step")), "ways")
    direct = edges.direct.withColumnRenamed("f", "from").join(keys.withColumnRenamed("f", "from"), "from").join(first, "ask", "left")
    direct = scratch.cut(direct.select(F.col("from").alias("f"), "v", "origin", "to_f", "to_v", "by_name", F.when(F.col("ask").isNull(), at).otherwise(after).alias("step")), "ways")
    stand = edges.results.join(bars, "group", "left").where("not by_name or least is not null").join(keys, "f").join(first, "ask")
    stand = scratch.cut(stand.select("group", "ask", F.col("f").alias("to_f"), F.col("v").alias("to_v"), "by_name", "least", after.alias("step")), "ways")
    given = scratch.cut(edges.given.drop("ask", "index").distinct(), "ways")
    made = edges.made.select("ask", "f", "v", "origin").distinct()
    start = seeds.select(*_VALUE, (F.col("origin") * 2 + F.col("dispatch").cast("int")).alias("cell"), F.array("why").alias("path"))
    begun = states.where("hops = 0").join(start, [*_VALUE, "cell"]).groupBy(*_VALUE, "cell", "hops").agg(F.min("path").alias("path"))
    done = now = scratch.cut(begun, "paths")
    nothing = F.array().cast("array<string>")
    shortest = lambda df, *by: df.groupBy(*by).agg(F.min("path").alias("path"))
    cell, path = F.col("cell").bitwiseOR(F.col("by_name").cast("int")).alias("cell"), F.concat("path", F.array("step")).alias("path")
    for hop in range(1, last + 1):

        def reached(rows: DataFrame, *keep: str) -> DataFrame:
            met = rows.join(now, _VALUE).select(*keep, "cell", "hops", "path")  # noqa: B023
            return met.unionByName(_constant(rows, *keep).withColumn("path", nothing)) if hop == 1 else met  # noqa: B023

        to_ask = shortest(reached(passed, "ask", "index", "by_name", "step").select("ask", "index", cell, path), "ask", "index", "cell")
        offered = to_ask.join(edges.members, "ask").select(F.col("fid").alias("f"), _slot(0, F.col("index")).alias("v"), "cell", "path")
        to = [F.col("to_f").alias("f"), F.col("to_v").alias("v"), cell, path]
        offered = offered.unionByName(reached(direct, "to_f", "to_v", "by_name", "step").select(*to))
        returned = shortest(reached(made, "ask"), "ask", "cell", "hops").join(stand, "ask").drop("ask", "group")
        through = reached(given, "group").join(stand, "group").drop("ask", "group")
        held = returned.unionByName(through).where(F.col("least").isNull() | (_strength() >= F.col("least")))
        offered = shortest(offered.unionByName(held.select(*to)), *_VALUE, "cell")
        now = scratch.cut(states.where(F.col("hops") == hop).join(offered, [*_VALUE, "cell"]).select(*_VALUE, "cell", "hops", "path"), "paths")
        done = done.unionByName(now)
    return done


def provenance(cell: Column, hops: Column, direct: Column) -> Column:
    """The claim's name: origin, distance and whether a call was resolved by name."""
    origin = F.element_at(F.array(*map(F.lit, ORIGIN_NAMES)), F.floor(cell / 2).cast("int") + 1)
    distance = F.when(hops == 0, F.when(direct, "direct").otherwise("entry")).when(hops == 1, "1hop").otherwise("nhop")
    return F.concat(origin, F.lit("_"), distance, F.when(cell % 2 == 1, "_dispatch").otherwise(""))


class Taint:
    """The settled claims of all values, with their paths."""

    def __init__(self, functions: DataFrame, modules: DataFrame, wire_types: DataFrame, triaged: DataFrame, scratch: Scratch, max_hops: int = MAX_HOPS, dispatch: bool = True):
        self.calls = Calls(functions, modules, scratch, dispatch)
        self.edges = Edges(self.calls, scratch)
        self.seeds = scratch.cut(seeds_of(self.calls, wire_types, triaged), "seeds")
        self.states, self.bars = fixpoint(self.edges, self.seeds, max_hops, scratch)
        self._scratch = scratch

    def claims(self, paths: bool = True) -> DataFrame:
        """f, v, cell, hops and path (null unless ``paths``) of the strongest claim of each value."""
        best = self.states.groupBy(*_VALUE).agg(F.min(_strength()).alias("best"))
        best = best.select(*_VALUE, F.floor(F.col("best") / _HOP_BITS).cast("int").alias("cell"), (F.col("best") % _HOP_BITS).cast("int").alias("hops"))
        if not paths:
            return best.withColumn("path", F.lit(None).cast("array<string>"))
        return best.drop("hops").join(paths_of(self.calls, self.edges, self.seeds, self.states, self.bars, self._scratch), [*_VALUE, "cell"])

    def parameters(self) -> DataFrame:
        """repo, function, index, origin, dispatch, hops, provenance and path of tainted parameters."""
        known = self.calls.functions.select("f", "repo", "key").distinct()
        named = self.claims().where("v % 3 = 0").withColumn("index", F.expr("cast(v div 3 as int)"))
        return named.join(known, "f").select("repo", F.col("key").alias("function"), "index", F.floor(F.col("cell") / 2).cast("int").alias("origin"), (F.col("cell") % 2 == 1).alias("dispatch"), "hops", provenance(F.col("cell"), F.col("hops"), F.lit(False)).alias("provenance"), "path")

    def sinks(self, retain: bool = False, paths: bool = True) -> DataFrame:
        """Sinks that external data reaches: see ``tainted_sinks``."""
        sinks = self.calls.functions.withColumn("__f", F.monotonically_increasing_id()).select("repo", "f", "key", "line", "params", "__f", F.posexplode("taint_sinks").alias("__s", "sink"))
        read = F.col("sink.type") == "unbounded_read"
        roots = F.coalesce("sink.roots", F.array())
        bomb = read & F.array_contains(roots, "body") & F.array_contains(roots, "decomp")  # what a compressed body expands to has no bound
        open_ = sinks if retain else sinks.where(~F.coalesce(read & F.array_contains(roots, "lim"), F.lit(False)))
        cut = self._scratch.cut(open_.withColumn("roots", F.when(bomb, F.concat(roots, F.array(F.lit("src")))).otherwise(roots)), "sinks")
        each = _rooted(cut.select("__f", "__s", "f", "roots"), "roots", F.lit(True))
        index = F.when(F.startswith("root", F.lit("param:")), F.expr("try_cast(substr(root, 7) as int)"))
        constant = _constant(each, "__f", "__s").withColumn("index", F.lit(None).cast("int")).withColumn("path", F.array().cast("array<string>"))
        met = each.where("v is not null").join(self.claims(paths), _VALUE).select("__f", "__s", "cell", "hops", index.alias("index"), "path")
        rank = F.struct("cell", "hops", F.col("index").isNull().alias("other"), F.coalesce("index", F.lit(0)).alias("at"), "path", "index")
        best = constant.unionByName(met).groupBy("__f", "__s").agg(F.min(rank).alias("b"))
        parameter = F.filter(F.coalesce("params", F.array()), lambda p: p["index"] == F.col("b.index"))
        first = F.coalesce(F.get(parameter, F.lit(0))["first_use"], F.lit(0))
        line = F.when((first > 0) & (first < F.col("sink.line")), first).otherwise(F.coalesce("line", "sink.line"))
        return cut.join(best, ["__f", "__s"]).select(
            "repo", F.col("key").alias("function"), F.col("sink.line").alias("sink_line"), F.col("sink.type").alias("sink_type"), F.substring(F.coalesce("sink.pattern", F.lit("")), 1, 80).alias("sink_desc"), line.alias("source_line"),
            F.coalesce(F.get(parameter, F.lit(0))["name"], F.lit("")).alias("source_desc"), provenance(F.col("b.cell"), F.col("b.hops"), F.col("b.index").isNull()).alias("provenance"), F.col("b.hops").alias("hops"), *([F.col("b.path").alias("path")] if paths else []))


def tainted_sinks(functions: DataFrame, modules: DataFrame, wire_types: DataFrame, triaged: DataFrame, scratch: Scratch, max_hops: int = MAX_HOPS, dispatch: bool = True, retain: bool = False, paths: bool = True) -> DataFrame:
    """repo, function, sink_line, sink_type, sink_desc, source_line, source_desc, provenance, hops and path of every sink that external data reaches.

    The source line is the parameter's first use if that comes before the sink, else the function's line.  Without ``paths``
    there is no column path, and none is built.
    """
    return Taint(functions, modules, wire_types, triaged, scratch, max_hops, dispatch).sinks(retain, paths)


def tainted_parameters(functions: DataFrame, modules: DataFrame, wire_types: DataFrame, triaged: DataFrame, scratch: Scratch, max_hops: int = MAX_HOPS, dispatch: bool = True) -> DataFrame:
    return Taint(functions, modules, wire_types, triaged, scratch, max_hops, dispatch).parameters()

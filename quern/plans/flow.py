"""Taint inside functions, from rows of expressions: what reaches which variable, all functions at once.

A producer parses code; here come its rows.  ``units`` are operands: function, unit, line, kind and targets (names of
variables that take the operand's value).  Kinds: assign (one target), multi (``a, b, err := f()``: err and ok take
nothing), decode (``Decode(&v)``: the targets take what receiver and arguments hold), range, return, and operand (taken by
none: an argument, an index).  ``expressions``: function, unit, start, end (first and last token, nested), kind,
name.  Kinds of expressions and the roots that they give or keep:

* ident: the roots of variable ``name``; call: what function ``name`` of the package returns of its own making;
  cross (``name``: line): call:line, a result to be resolved elsewhere; source (``name``: src or io) that root; body: body;
* stop (a sanitizer, len, cap, a closure): nothing inside counts; outbound: resp, and nothing inside counts;
* limit and decompress: lim or decomp, and what is inside without lim;
* assert to a plain type: wire, if nothing inside has a root.

Roots spread without regard to the order of statements, to a fixed point: a variable that is assigned anew keeps what it
had, as a branch or a loop may skip the assignment.  Returned values carry origins to callers in the same
rounds.  Each round joins only new (variable, root) rows to the edges and is cut to a table in the shared folder; how
deep an expression nests costs no rounds, as one sort of its intervals tells what stops or limits each leaf.

Whether an assertion finds nothing inside is asked once all else is settled, so its answer doesn't depend on the order
of rows.  Objects (requests, writers, contexts: parameters with ``object``) keep the roots that they begin with, and
take only lim.

Defined cases: null names, targets and lists name nothing; rows that repeat count once; a unit without expressions
has no roots, and one without targets passes none on; cycles end as nothing new is found; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import Scratch

#: Roots that say where data comes from, and results that carry none.
ORIGINS = ("src", "entry", "wire", "io", "cb")
NO_VALUE = ("err", "ok")
#: What an edge carries.
ALL, UNLIMITED, ORIGIN, LIMIT = range(4)
_STOPS, _LIMITS = ("stop", "outbound"), ("limit", "decompress")
_GIVES = {"body": "body", "outbound": "resp", "limit": "lim", "decompress": "decomp"}


def _node(kind: str, *parts: str) -> Column:
    return F.concat_ws("\x01", F.lit(kind), *[F.col(p).cast("string") for p in parts])


def leaves(expressions: DataFrame) -> DataFrame:
    """Expressions that give roots and aren't inside one that stops them; ``limited`` inside one that limits."""
    before = Window.partitionBy("function", "unit").orderBy("start", F.col("end").desc(), "kind", "name").rowsBetween(Window.unboundedPreceding, -1)
    end_of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("end"))).over(before)
    # intervals nest: one that began before and ends no earlier holds this one
    inside = expressions.distinct().withColumn("__stop", end_of(*_STOPS)).withColumn("__limit", end_of(*_LIMITS))
    within = lambda c: F.coalesce(F.col(c) >= F.col("end"), F.lit(False))
    open_ = inside.where(~within("__stop") & (F.col("kind") != "stop"))
    return open_.select("function", "unit", "start", "end", "kind", "name", within("__limit").alias("limited"))


def seeds_of(parameters: DataFrame, closures: DataFrame, validators: DataFrame) -> DataFrame:
    """function, name, root: what variables hold before any statement.

    ``parameters``: function, index, name, type, object, request; ``closures``: the parameters of function literals, with
    escapes (handed to code that will call them); ``validators``: function, line, args, result (variables of calls of validators).
    """
    named = parameters.where("name <> '_'")
    own = F.when(F.col("request"), "entry").when(F.col("type") == "*http.Response", "resp").otherwise(F.concat(F.lit("param:"), F.col("index").cast("string")))
    inner = F.when(F.col("request"), "entry").when(F.col("escapes") & ~F.col("object"), "cb")
    given = named.select("function", "name", own.alias("root")).unionByName(closures.where("name <> '_'").select("function", "name", inner.alias("root")))
    objects = objects_of(parameters, closures)
    checked = validators.select("function", "line", F.explode("args").alias("name")).join(objects, ["function", "name"], "left_anti").select("function", "name", F.concat(F.lit("varg:"), F.col("line").cast("string")).alias("root"))
    verdict = validators.select("function", F.col("result").alias("name"), F.concat(F.lit("vret:"), F.col("line").cast("string")).alias("root"))
    return given.unionByName(checked).unionByName(verdict.join(objects, ["function", "name"], "left_anti")).where("name <> '' and root is not null").distinct()


def objects_of(parameters: DataFrame, closures: DataFrame) -> DataFrame:
    return parameters.where("object").select("function", "name").unionByName(closures.where("object").select("function", "name")).distinct()


def _keeps(carries: Column, root: Column) -> Column:
    return F.when(carries == ALL, True).when(carries == UNLIMITED, root != "lim").when(carries == ORIGIN, root.isin(*ORIGINS)).otherwise(root == "lim")


def _spread(states: DataFrame, fresh: DataFrame, edges: DataFrame, max_rounds: int | None, scratch: Scratch) -> DataFrame:
    """All (node, root) that follow from ``states``, of which ``fresh`` weren't passed on yet."""
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        offered = edges.join(fresh, F.col("src") == F.col("node")).where(_keeps(F.col("carries"), F.col("root"))).select(F.col("dst").alias("node"), "root").distinct()
        fresh = scratch.cut(offered.join(states, ["node", "root"], "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        states = scratch.cut(states.unionByName(fresh), "roots")
    return states


class Flow:
    """Roots of all variables, returned values and operands."""

    def __init__(self, units: DataFrame, expressions: DataFrame, seeds: DataFrame, objects: DataFrame, scratch: Scratch, max_rounds: int | None = None):
        self._scratch = scratch
        units = scratch.cut(units.select("function", "unit", "line", "kind", "targets"), "units")
        found = scratch.cut(leaves(expressions), "leaves")
        variable = units.select("function", "unit", "kind", F.explode("targets").alias("name")).where("name <> '' and name <> '_'")
        variable = variable.where((F.col("kind") != "multi") | ~F.col("name").isin(*NO_VALUE))
        held = objects.join(seeds.select("function", "name").distinct(), ["function", "name"]).distinct().withColumn("held", F.lit(True))
        takes = variable.join(held, ["function", "name"], "left").select("function", "unit", _node("V", "function", "name").alias("dst"), F.coalesce("held", F.lit(False)).alias("held"))
        returned = units.where("kind = 'return'").select("function", "unit", _node("R", "function").alias("dst"), F.lit(False).alias("held"))
        takes = scratch.cut(takes.unionByName(returned).distinct(), "takes")

        src = F.when(F.col("kind") == "ident", _node("V", "function", "name")).when(F.col("kind") == "call", _node("R", "name"))
        root = F.when(F.col("kind") == "source", F.col("name")).when(F.col("kind") == "cross", F.concat(F.lit("call:"), "name"))
        for kind, gives in _GIVES.items():
            root = F.when(F.col("kind") == kind, gives).otherwise(root)
        carries = F.when(F.col("kind") == "call", ORIGIN).when(F.col("limited"), UNLIMITED).otherwise(ALL)
        self._leaves = scratch.cut(found.select("function", "unit", "start", "end", "kind", src.alias("src"), F.when(~(F.col("limited") & (root == "lim")), root).alias("root"), carries.alias("carries")).where("src is not null or root is not null or kind = 'assert'"), "given")
        met = self._leaves.join(takes, ["function", "unit"])
        edges = met.where("src is not null").select("src", "dst", F.when(F.col("held"), LIMIT).otherwise(F.col("carries")).alias("carries")).distinct()
        # a limited value gives no lim to an object
        edges = scratch.cut(edges, "edges")
        fixed = met.where("root is not null and (not held or root = 'lim')").select(F.col("dst").alias("node"), "root")
        begun = scratch.cut(seeds.select(_node("V", "function", "name").alias("node"), "root").unionByName(fixed).distinct(), "begun")
        settled = _spread(begun, begun, edges, max_rounds, scratch)
        # what assertions find, when all else is settled
        asserts = self._leaves.where("kind = 'assert'").select("function", "unit", F.col("start").alias("a"), F.col("end").alias("z"))
        inner = self._leaves.where("kind <> 'assert'").join(asserts, ["function", "unit"]).where("start >= a and end <= z")
        known = inner.where("root is not null").select("function", "unit", "a")
        known = known.unionByName(inner.join(settled.withColumnRenamed("root", "r"), F.col("src") == F.col("node")).where(_keeps(F.col("carries"), F.col("r"))).select("function", "unit", "a"))
        self._wire = scratch.cut(asserts.join(known.distinct(), ["function", "unit", "a"], "left_anti").select("function", "unit").distinct(), "asserted")
        wired = self._wire.join(takes.where("not held"), ["function", "unit"]).select(F.col("dst").alias("node"), F.lit("wire").alias("root")).distinct()
        fresh = scratch.cut(wired.join(settled, ["node", "root"], "left_anti"), "fresh")
        self._roots = _spread(scratch.cut(settled.unionByName(fresh), "roots"), fresh, edges, max_rounds, scratch)
        self.units = units

    def variables(self) -> DataFrame:
        """function, name, root of every variable that has one."""
        parts = F.split("node", "\x01")
        return self._roots.where(F.startswith("node", F.lit("V\x01"))).select(parts[1].alias("function"), parts[2].alias("name"), "root")

    def roots(self) -> DataFrame:
        """function, unit, line, kind and the sorted ``roots`` of every unit."""
        met = self._leaves.join(self._roots.withColumnRenamed("root", "r"), F.col("src") == F.col("node")).where(_keeps(F.col("carries"), F.col("r"))).select("function", "unit", F.col("r").alias("root"))
        given = self._leaves.where("root is not null").select("function", "unit", "root").unionByName(self._wire.withColumn("root", F.lit("wire")))
        per = met.unionByName(given).groupBy("function", "unit").agg(F.array_sort(F.collect_set("root")).alias("roots"))
        return self.units.select("function", "unit", "line", "kind").distinct().join(per, ["function", "unit"], "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))

    def returns(self) -> DataFrame:
        """function, origins (of its own making) and ret_params (indexes that it passes through) of functions that return a value."""
        each = self.roots().where("kind = 'return'").select("function", F.explode_outer("roots").alias("root"))
        index = F.expr("try_cast(substr(root, 7) as int)")
        return each.groupBy("function").agg(
            F.array_sort(F.collect_set(F.when(F.col("root").isin(*ORIGINS), F.col("root")))).alias("origins"),
            F.array_sort(F.collect_set(F.when(F.startswith("root", F.lit("param:")), index))).alias("ret_params"))


def tracked(units: DataFrame, idents: DataFrame, seeds: DataFrame, scratch: Scratch, max_rounds: int | None = None) -> DataFrame:
    """function, name of variables that hold a parsed number, or were assigned from an expression that names one.

    ``idents``: function, unit, name of all variables that a unit's expression names; ``seeds``: function, name.
    """
    takes = units.where("kind = 'assign'").select("function", "unit", F.explode("targets").alias("to")).where("to <> '_'")
    edges = idents.join(takes, ["function", "unit"]).select(_node("V", "function", "name").alias("src"), _node("V", "function", "to").alias("dst"), F.lit(ALL).alias("carries")).where("src <> dst").distinct()
    edges = scratch.cut(edges, "edges")
    begun = scratch.cut(seeds.where("name <> '_'").select(_node("V", "function", "name").alias("node"), F.lit("size").alias("root")).distinct(), "begun")
    parts = F.split("node", "\x01")
    return _spread(begun, begun, edges, max_rounds, scratch).select(parts[1].alias("function"), parts[2].alias("name"))


def size_flows(uses: DataFrame, idents: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sinks, range checks) of variables that hold a parsed number: function, line, var, pattern and, of sinks, type.

    ``uses``: function, unit, call (of one make, index or comparison), arg, kind (make, index, compare), line, text; ``held`` as
    ``tracked`` gives it.  Of an operand's variables the first by name counts, of a make the first operand that has one.
    Functions without sinks have no checks.
    """
    named = uses.join(idents, ["function", "unit"]).join(held, ["function", "name"])
    first = named.groupBy("function", "call", "kind", "line", "text").agg(F.min(F.struct("arg", "name"))["name"].alias("var"))
    kinds = F.when(F.col("kind") == "make", "alloc_size").when(F.col("kind") == "index", "index_access")
    sinks = first.where("kind <> 'compare'").select("function", "line", kinds.alias("type"), "var", F.col("text").alias("pattern"))
    checks = first.where("kind = 'compare'").select("function", "line", "var", F.col("text").alias("pattern"))
    return sinks, checks.join(sinks.select("function").distinct(), "function", "left_semi")

"""Bounded reachability over edge tables.

Each round joins only the states that changed to the edges, keeps the best state of each
node by a struct minimum, and is cut to a table in the shared folder, so that lineage
doesn't grow.  Rounds are bounded by the hop limit; the loop ends early when nothing changes.

Defined cases: a null node has no edges; edges and seeds that repeat count once; a cycle ends as its
states don't improve; no seeds reach nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import Scratch


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int, scratch: Scratch) -> DataFrame:
    """node, state: for each node the best (origin, dispatch, hops, path) by which a seed reaches it.

    ``edges``: caller, callee, dispatch, label.  ``seeds``: node, origin, label.  States compare by
    origin, then exact before dispatch, then hops, then path; a state goes on from its caller's best, so its path
    is the least of those.  (``plans.taint`` keeps a state of each kind, where a cap on hops must lose nothing.)
    """
    edges = scratch.cut(edges.where("caller <> callee").select("caller", "callee", "dispatch", "label").distinct(), "edges")
    state = F.struct("origin", F.lit(False).alias("dispatch"), F.lit(0).alias("hops"), F.array("label").alias("path"))
    best = scratch.cut(seeds.select("node", state.alias("state")).groupBy("node").agg(F.min("state").alias("state")), "reach")
    fresh = best
    for _ in range(max_hops):
        step = fresh.join(edges, fresh.node == edges.caller).where(F.col("state.hops") < max_hops)
        moved = F.struct(
            F.col("state.origin"), (F.col("state.dispatch") | F.col("dispatch")).alias("dispatch"),
            (F.col("state.hops") + 1).alias("hops"), F.concat(F.col("state.path"), F.array("label")).alias("path"))
        offers = step.select(F.col("callee").alias("node"), moved.alias("offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        both = best.join(offers, "node", "full")
        changed = F.col("offer").isNotNull() & (F.col("state").isNull() | (F.col("offer") < F.col("state")))
        after = scratch.cut(both.select("node", F.when(changed, F.col("offer")).otherwise(F.col("state")).alias("state"), changed.alias("changed")), "reach")
        best, fresh = after.select("node", "state"), after.where("changed").select("node", "state")
        if fresh.isEmpty():
            break
    return best


def two_deep(edges: DataFrame, caller: str, callee: str) -> DataFrame:
    """root, callee, depth: what each caller calls, and what its callees call, each once at its least depth."""
    e = edges.select(F.col(caller).alias("root"), F.col(callee).alias("callee")).distinct()
    second = e.join(e.select(F.col("root").alias("mid"), F.col("callee").alias("far")), F.col("callee") == F.col("mid")).select("root", F.col("far").alias("callee"), F.lit(2).alias("depth"))
    return e.withColumn("depth", F.lit(1)).unionByName(second).groupBy("root", "callee").agg(F.min("depth").alias("depth"))


def reached_sinks(sinks: DataFrame, states: DataFrame, roots: str, skipped: tuple[str, ...]) -> DataFrame:
    """Sinks with the best state among their roots (``key``, root); sinks without one drop, repeated ones come out as often.

    ``sinks``: sink, key and the array ``roots``; ``states``: key, root, state.  On equal rank a
    parameter root is preferred.
    """
    places = sinks.select("key", roots).distinct()
    each = places.select("*", F.explode(roots).alias("root")).where(~F.col("root").isin(*skipped) & ~F.col("root").rlike("^(varg|vret):"))
    met = each.join(states, ["key", "root"])
    rank = F.struct(F.col("state.origin"), F.col("state.dispatch"), F.col("state.hops"), (~F.startswith("root", F.lit("param:"))).alias("other"), "root")
    best = met.groupBy("key", roots).agg(F.min(F.struct(rank.alias("rank"), "state", "root")).alias("__b"))
    return sinks.join(best, ["key", roots]).select(*sinks.columns, "__b.state", F.col("__b.root").alias("by_root"))


def weakest_if_all(candidates: DataFrame, key: list[str], total: Column, state: str) -> DataFrame:
    """For dispatch by name: the worst state, and only of keys all of whose candidates have one."""
    return candidates.groupBy(*key).agg(F.count(state).alias("n"), F.max(total).alias("of"), F.max(state).alias(state)).where("n = of").select(*key, state)

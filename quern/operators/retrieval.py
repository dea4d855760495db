"""The k nearest items by weighted shared tokens, without meeting on frequent ones.

Tokens are met rarest first.  Queries meet items on tokens that at most ``common`` items have; what the others could
add is bounded by their weights.  If that can lift no further item into a query's first k, the query is done: those
of its items that the bound leaves open get the rest of their score from arrays of their frequent tokens, pair by pair.
Queries that aren't done meet on tokens ``growth`` times as frequent, until all tokens are met: whatever the weights,
results are exact, and a token that all items have is joined on only for queries that have nothing else.

Defined cases: tokens without weight count nothing; pairs that repeat count once; null queries, items and tokens meet none;
a query that shares no token has no row; of equal (rounded) scores the smaller item comes first; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import Scratch

#: What sums of weights may differ by when added in another order.
SLACK = 1e-9


def top_k(queries: DataFrame, items: DataFrame, weights: DataFrame, k: int, scratch: Scratch, common: int = 64, growth: int = 16, digits: int = 4, itself: bool = True) -> DataFrame:
    """query, item, shared, score (to ``digits``) and place of the k best items of each query; not ``itself``: an item of a query's name is none of them.

    ``queries``: query, token; ``items``: item, token; ``weights``: token, idf (not negative).
    """
    frequency = items.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    known = scratch.cut(weights.join(frequency, "token").where("idf is not null").select("token", "idf", "df"), "weights")
    q = scratch.cut(queries.distinct().join(known, "token").select("query", "token", "idf", "df"), "queries")
    held = scratch.cut(items.distinct().join(known.select("token", "df"), "token").select("item", "token", "df"), "items")
    most = known.agg(F.max("df")).first()[0]
    rounding = 10.0**-digits + SLACK  # rounded scores tie within this
    out, open_, limit = None, q, common
    while most is not None:
        last = limit >= most
        term = F.struct("token", "idf")
        met = open_.where(F.col("df") <= limit).join(held.where(F.col("df") <= limit).select("item", "token"), "token")
        met = met if itself else met.where("query <> item")
        met = scratch.cut(met.groupBy("query", "item").agg(F.sum("idf").alias("some"), F.collect_list(term).alias("terms")), "met")
        rest = open_.groupBy("query").agg(F.coalesce(F.sum(F.when(F.col("df") > limit, F.col("idf"))), F.lit(0.0)).alias("bound"), F.collect_list(F.when(F.col("df") > limit, F.struct("token", "idf"))).alias("frequent"))
        kth = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("some"), "item"))).where(F.col("r") == k).select("query", F.col("some").alias("kth"))
        judged = scratch.cut(rest.join(kth, "query", "left"), "judged")
        # an item that shares frequent tokens alone can't come among the first k
        done = F.lit(True) if last else (F.col("bound") == 0) | (F.col("bound") + rounding < F.col("kth"))
        settled = judged.where(F.coalesce(done, F.lit(False)))
        near = met.join(settled, "query").where(F.col("kth").isNull() | (F.col("some") + F.col("bound") + rounding >= F.col("kth")))
        if last:
            whole = near.select("query", "item", "terms")
        else:
            frequent = held.where(F.col("df") > limit).groupBy("item").agg(F.collect_list("token").alias("own"))
            both = near.join(frequent, "item", "left")
            shared = F.array_intersect(F.transform("frequent", lambda t: t["token"]), F.coalesce("own", F.array().cast("array<string>")))
            idf = F.map_from_entries("frequent")
            more = F.transform(shared, lambda t: F.struct(t.alias("token"), F.element_at(idf, t).alias("idf")))
            whole = both.select("query", "item", F.concat("terms", more).alias("terms"))
        # summed in the tokens' order, whatever order they arrived in
        score = F.aggregate(F.array_sort("terms"), F.lit(0.0), lambda a, t: a + t["idf"])
        scored = whole.select("query", "item", F.size("terms").cast("long").alias("shared"), F.round(score, digits).alias("score"))
        best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))).where(F.col("place") <= k)
        best = scratch.cut(best, "best")
        out = best if out is None else out.unionByName(best)
        if last:
            break
        open_ = scratch.cut(open_.join(settled.select("query"), "query", "left_anti"), "open")
        if open_.isEmpty():
            break
        limit *= growth
    if out is None:
        return q.select("query", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("score"), F.lit(0).alias("place")).where("false")
    return out

"""Aggregations: grouped templates, inverted indexes, outliers among peers, summaries, retrieval.

Defined cases: a null group is a group, but meets nothing where groups are joined (outliers, scores);
null values don't count as values; repeated rows each count, but in sets and distinct pairs; ties
follow the order given and must be broken by it; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_values(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """``group`` and top: its ``k`` most frequent values, ties by value."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(value))
    ranked = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return ranked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(value).alias("v")))), lambda x: x["v"]).alias("top"))


def most_common(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """``group`` and dominant: the most frequent value; of ties, the one seen first by ``order``."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return counted.groupBy(*group).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "o")).alias("dominant"))


def inverted_index(df: DataFrame, key: Column, member: str) -> DataFrame:
    """key, members: the sorted distinct members of each value of the array or scalar ``key``."""
    return df.select(key.alias("key"), member).where("key is not null").groupBy("key").agg(F.array_sort(F.collect_set(member)).alias("members"))


def peer_outliers(members: DataFrame, group: list[str], checked: Column, least: int = 3, share: float = 0.5) -> DataFrame:
    """Members that don't check in groups of at least ``least`` where at least ``share`` do; with peers and checked_peers."""
    stats = members.groupBy(*group).agg(F.count("*").alias("peers"), F.count_if(checked).alias("checked_peers"))
    odd = stats.where((F.col("peers") >= least) & (F.col("checked_peers") >= share * F.col("peers")))
    return members.where(~checked).join(odd, group)


def shares(df: DataFrame, value: str, least: float = 0.1, gain: float = 2.0) -> DataFrame:
    """value, n and confidence = min(1, gain * share) of values that hold at least ``least`` of all rows."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0  # a scalar
    if not total:
        return counted.select(value, "n", F.lit(0.0).alias("confidence"))
    share = F.col("n") / F.lit(total)
    return counted.where(share >= least).select(value, "n", F.least(F.lit(1.0), gain * share).alias("confidence"))


def summary(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """One row for each value of each column of ``by`` and one overall: facet, value, n, top and mean (one decimal) of ``score``."""
    sets = [[c] for c in by] + [[]]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, by)).agg(
        F.count("*").alias("n"), F.max(score).alias("top"), F.round(F.avg(score), 1).alias("mean"), *[F.grouping(c).alias(f"g_{c}") for c in by])
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for c in by:
        facet, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(facet), F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n", "top", "mean")


def idf(tokens: DataFrame, doc: str, token: str, unique: bool = False) -> DataFrame:
    """token and idf = ln((N + 1) / (df + 0.5)) over distinct (doc, token); ``unique`` says that no pair repeats, which saves a shuffle of them."""
    distinct = tokens.select(doc, token) if unique else tokens.select(doc, token).distinct()
    n = distinct.select(doc).distinct().count()
    return distinct.groupBy(token).agg(F.log(F.lit(n + 1) / (F.count("*") + 0.5)).alias("idf"))


def overlap_scores(queries: DataFrame, docs: DataFrame, token: str, query: str, doc: str, weights: DataFrame | None = None) -> DataFrame:
    """query, doc, shared and score: the weights (default 1) of tokens they share, summed in token order."""
    q, d = queries.select(query, token).distinct(), docs.select(doc, token).distinct()
    met = q.join(d, token)
    met = met.join(weights, token) if weights is not None else met.withColumn("idf", F.lit(1.0))
    # a sorted sum makes the floating-point result independent of the order of arrival
    terms = F.sort_array(F.collect_list(F.struct(token, "idf")))
    return met.groupBy(query, doc).agg(F.count("*").alias("shared"), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["idf"]).alias("score"))


def best_of_each(df: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, numbered in ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def limited_class(df: DataFrame, group: list[str], order: list[Column], limited: Column, k: int, at_most: int = 1) -> DataFrame:
    """The first ``k`` of each group by ``order``, of which at most ``at_most`` are ``limited``."""
    w = Window.partitionBy(*group).orderBy(*order)
    running = F.sum(limited.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    allowed = df.withColumn("__l", limited).withColumn("__c", running).where(~F.col("__l") | (F.col("__c") <= at_most)).drop("__l", "__c")
    return best_of_each(allowed, group, order, k)


def units(findings: DataFrame, by: list[str], severity_rank: Column, confidence: str, sets: list[str]) -> DataFrame:
    """Findings grouped to review units: least severity rank, top confidence, n, sorted sets of the other columns."""
    return findings.groupBy(*by).agg(
        F.min(severity_rank).alias("severity_rank"), F.max(confidence).alias("confidence"), F.count("*").alias("n"),
        *[F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in sets])


def counters(streams: list[tuple[str, DataFrame]], value: str, category: str) -> DataFrame:
    """value, total, by_category and by_stream (maps) over tagged streams of (value, category)."""
    tagged = None
    for name, df in streams:
        t = df.select(value, F.col(category).cast("string").alias("category"), F.lit(name).alias("stream"))
        tagged = t if tagged is None else tagged.unionByName(t)
    base = tagged.groupBy(value, "category", "stream").agg(F.count("*").alias("n"))
    per = lambda c: base.groupBy(value, c).agg(F.sum("n").alias("n")).groupBy(value).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(c), "n")))).alias(f"by_{c}"))
    total = base.groupBy(value).agg(F.sum("n").alias("total"))
    return total.join(per("category"), value).join(per("stream"), value)

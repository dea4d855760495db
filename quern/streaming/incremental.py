"""Resumable and budgeted batch state, and a streaming form of it.

The batch operators mirror what the rule pipeline keeps between runs; ``stream_pending`` and
``stream_windows`` are extensions on Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(tasks: DataFrame, done: DataFrame, key: list[str], failed: Column, retry_failed: bool = True) -> DataFrame:
    """Tasks without a result; with ``retry_failed``, one that failed is no result."""
    finished = done.where(~failed) if retry_failed else done
    return tasks.join(finished.select(*key).distinct(), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key isn't in ``new``, and the new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def kept_when_empty(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key, where a null field of the new keeps the old."""
    fields = [c for c in new.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"__old_{c}") for c in fields])
    return new.join(o, key, "full").select(*key, *[F.coalesce(c, f"__old_{c}").alias(c) for c in fields])


def budgeted(tasks: DataFrame, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """Tasks with turn (from 1) and within: whether the budget of their group reaches them."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return tasks.withColumn("turn", turn).withColumn("within", F.col("turn") <= budget)


def cached(requests: DataFrame, cache: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests joined to recorded replies by the hash of their payload."""
    keyed = requests.withColumn("cache_key", F.sha2(F.to_json(F.struct(*payload)), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")


def stream_pending(tasks: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """A stream of tasks, each once within the watermark's delay."""
    return tasks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def stream_windows(events: DataFrame, ts: str, by: list[str], size: str, delay: str, value: str) -> DataFrame:
    """Counts and sums of a stream by tumbling window; late rows beyond ``delay`` drop."""
    w = F.window(ts, size)
    out = events.withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")

"""Range, nearest and as-of joins over positions inside a group.

All take column names, so the same operator serves rule tables and any other data.  The
group columns are always equi-join keys: Spark plans hash or sort-merge joins with the
range as a residual condition, never a nested loop.

Defined cases: a null group or position equals nothing, so its rows pair with none, protect
nothing and stay unprotected; repeated rows each count; of ties the docstrings say which holds;
empty tables give empty results.  Columns that begin with two underscores are the module's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(left: str, right: str, group: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{g}") == F.col(f"{right}.{g}") for g in group])


def _prefixed(alias: str, prefix: str, columns: list[str], group: list[str]) -> list[Column]:
    return [F.col(f"{alias}.{c}").alias(f"{prefix}{c}") for c in columns if c not in group]


def span_join(sources: DataFrame, sinks: DataFrame, group: list[str], pos: str, drift: int = 2) -> DataFrame:
    """All (source, sink) pairs of a group, but those on one line and those whose sink is 1..``drift`` before its source.

    Columns of the sides are prefixed ``source_`` and ``sink_``; ``lo`` and ``hi`` are the sorted ends.
    """
    s, k = sources.alias("s"), sinks.alias("k")
    gap = F.col(f"s.{pos}") - F.col(f"k.{pos}")
    pairs = s.join(k, _on("s", "k", group) & (gap != 0) & ~gap.between(1, drift))
    return pairs.select(
        *[F.col(f"s.{g}").alias(g) for g in group],
        *_prefixed("s", "source_", sources.columns, group), *_prefixed("k", "sink_", sinks.columns, group),
        F.least(f"s.{pos}", f"k.{pos}").alias("lo"), F.greatest(f"s.{pos}", f"k.{pos}").alias("hi"),
    )


def unprotected(spans: DataFrame, checks: DataFrame, on: list[str], pos: str = "line", lo: str = "lo", hi: str = "hi", closed_low: bool = False) -> DataFrame:
    """Spans without a check strictly between their ends (``closed_low``: or at the low end); ``on`` are equal in span and check."""
    a, c = spans.alias("a"), checks.alias("c")
    low = F.col(f"c.{pos}") >= F.col(f"a.{lo}") if closed_low else F.col(f"c.{pos}") > F.col(f"a.{lo}")
    return a.join(c, _on("a", "c", on) & low & (F.col(f"c.{pos}") < F.col(f"a.{hi}")), "left_anti")


def first_unprotected(events: DataFrame, group: list[str], pos: str, source: Column, sink: Column, check: Column) -> DataFrame:
    """For each sink, the earliest source before it with no check between: ``group``, source_pos, sink_pos.

    The checks before a row number its segment; a sink's unprotected sources are the earlier
    ones of its segment.  Two windows over one sort, however many sources and sinks a group has.
    """
    in_group = Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    segments = events.where(source | sink | check).withColumn("__segment", F.count_if(check).over(in_group))
    in_segment = Window.partitionBy(*group, "__segment").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(source, F.col(pos))).over(in_segment)
    found = segments.withColumn("source_pos", first).where(sink & (F.col("source_pos") < F.col(pos)))
    return found.select(*group, "source_pos", F.col(pos).alias("sink_pos"))


def snap(facts: DataFrame, anchors: DataFrame, group: list[str], pos: str, reach: int = 2, into: str = "snapped") -> DataFrame:
    """``facts`` with the nearest anchor's position within ``reach`` (ties: the smaller), else their own, in column ``into``.

    Facts and anchors are sorted together once up and once down, and each fact looks at the last
    anchor before it in both: no pairs, and rows that repeat or have no position stay as they are.
    """
    marks = anchors.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*group, pos]]))
    rows = facts.select(*group, F.col(pos).alias("__p"), F.struct(*facts.columns).alias("__row"), F.lit(None).cast(facts.schema[pos].dataType).alias("__at"))
    both = rows.unionByName(marks.select(*group, F.col(pos).alias("__p"), F.col(pos).cast(facts.schema[pos].dataType).alias("__at")).distinct(), allowMissingColumns=True)
    frame = (Window.unboundedPreceding, Window.currentRow)  # rows of one position are peers
    up, down = (Window.partitionBy(*group).orderBy(o).rangeBetween(*frame) for o in (F.col("__p").asc(), F.col("__p").desc()))
    seen = both.withColumn("__low", F.max("__at").over(up)).withColumn("__high", F.min("__at").over(down)).where(F.col("__row").isNotNull())
    below, above = F.col("__p") - F.col("__low"), F.col("__high") - F.col("__p")
    near = F.when((below <= reach) & ((below <= above) | above.isNull()), F.col("__low")).when(above <= reach, F.col("__high")).otherwise(F.col("__p"))
    return seen.select("__row.*", near.alias(into))


def collapsed(findings: DataFrame, by: list[str], rank: list[Column]) -> DataFrame:
    """The first row of each group by ``rank``, which must be total for a repeatable choice."""
    order = Window.partitionBy(*by).orderBy(*rank)
    return findings.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_before(events: DataFrame, earlier: DataFrame, group: list[str], pos: str, into: str = "first_pos") -> DataFrame:
    """Events with the smallest position strictly before theirs in ``earlier``; events without one drop.

    The earliest position of a group is before an event or none is, so the minimum of each
    group is joined, not all its rows.
    """
    least = earlier.groupBy(*group).agg(F.min(pos).alias(into))
    return events.join(least, group).where(F.col(into) < F.col(pos))


def latest_at(events: DataFrame, history: DataFrame, group: list[str], pos: str, value: str, into: str, inclusive: bool = True) -> DataFrame:
    """As-of join backwards: ``value`` of the latest row of ``history`` at or before (else: strictly before) each event.

    One sort of both sides together and a running last, so that no pairs are made.  Of
    history rows at one position, the largest value counts.
    """
    both = events.select(*group, F.col(pos).alias("__p"), F.lit(1 if inclusive else 0).alias("__event"), F.struct(*events.columns).alias("__row"), F.lit(None).cast(history.schema[value].dataType).alias("__v"), F.lit(True).alias("__is"))
    past = history.select(*group, F.col(pos).alias("__p"), F.lit(0 if inclusive else 1).alias("__event"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.lit(False).alias("__is"))
    order = Window.partitionBy(*group).orderBy("__p", "__event", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = both.unionByName(past).withColumn(into, F.last("__v", ignorenulls=True).over(order))
    return running.where("__is").select("__row.*", into)


def preceding_top(events: DataFrame, history: DataFrame, group: list[str], pos: str, k: int, event_key: list[str], order: list[str]) -> DataFrame:
    """Up to ``k`` latest rows of ``history`` strictly before each event, numbered 1.. in ``nth``; ``order`` breaks ties.

    History is numbered in its group; an event counts the rows before it and meets the last ``k``
    of them by number, so rows grow with ``k`` and not with the group.
    """
    numbered = history.where(F.col(pos).isNotNull()).withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(pos).asc(), *[F.col(c).desc() for c in order])))
    rows = events.select(*group, F.col(pos).alias("__p"), F.lit(0).alias("__h"), F.struct(*events.columns).alias("__row"))
    both = rows.unionByName(numbered.select(*group, F.col(pos).alias("__p"), F.lit(1).alias("__h")), allowMissingColumns=True)
    running = Window.partitionBy(*group).orderBy("__p", "__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("__c", F.sum("__h").over(running)).where("__h = 0 and __c > 0")
    wanted = counted.select("__row", "__c", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("__c")).cast("int"))).alias("nth"))
    wanted = wanted.select("__row", "nth", *[F.col(f"__row.{g}").alias(g) for g in group], (F.col("__c") - F.col("nth") + 1).cast("int").alias("__rn"))
    met = wanted.join(numbered.select(*group, "__rn", *[F.col(c).alias(f"prior_{c}") for c in history.columns if c not in group]), [*group, "__rn"])
    return met.select("__row.*", *[f"prior_{c}" for c in history.columns if c not in group], "nth")


def enclosing(points: DataFrame, ranges: DataFrame, group: list[str], pos: str, start: str, end: str) -> DataFrame:
    """Points joined to all ranges of their group with start <= pos <= end; range columns keep their names."""
    p, r = points.alias("p"), ranges.alias("r")
    inside = _on("p", "r", group) & F.col(f"p.{pos}").between(F.col(f"r.{start}"), F.col(f"r.{end}"))
    return p.join(r, inside).select(*[F.col(f"p.{c}").alias(c) for c in points.columns], *[F.col(f"r.{c}").alias(c) for c in ranges.columns if c not in group])


def innermost(points: DataFrame, ranges: DataFrame, group: list[str], pos: str, start: str, end: str, keep: str, into: str) -> DataFrame:
    """Points with ``keep`` of the innermost range of their group with start <= pos <= end in ``into``; null outside of all.

    The ranges must nest.  Starts, points and ends are sorted once; the number of open ranges is a running sum, and the
    range that a point lies in is the last one that was opened at its depth: no pairs, however deep ranges nest.
    """
    row, value = points.schema, ranges.schema[keep].dataType
    begin = ranges.select(*group, F.col(start).alias("__p"), F.lit(0).alias("__o"), (-F.col(end)).cast("long").alias("__e"), F.lit(1).alias("__d"), F.col(keep).alias("__v"))
    close = ranges.select(*group, F.col(end).alias("__p"), F.lit(2).alias("__o"), F.lit(0).cast("long").alias("__e"), F.lit(-1).alias("__d"), F.lit(None).cast(value).alias("__v"))
    here = points.select(*group, F.col(pos).alias("__p"), F.lit(1).alias("__o"), F.lit(0).cast("long").alias("__e"), F.lit(0).alias("__d"), F.lit(None).cast(value).alias("__v"), F.struct(*points.columns).alias("__row"))
    none = F.lit(None).cast(here.schema["__row"].dataType)
    events = begin.unionByName(close).withColumn("__row", none).unionByName(here)
    order = ["__p", "__o", "__e"]
    depth = events.withColumn("__n", F.sum("__d").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    level = Window.partitionBy(*group, "__n").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at no depth nothing is open; an end belongs to the depth around it and opens nothing there
    held = depth.withColumn(into, F.when(F.col("__n") > 0, F.last("__v", ignorenulls=True).over(level)))
    return held.where("__o = 1").select(*[F.col(f"__row.`{f.name}`").alias(f.name) for f in row], into)


def outermost(ranges: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Ranges that lie in no other of their group; of equal ones all.  The ranges must nest."""
    before = Window.partitionBy(*group).orderBy(start, F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = ranges.select(*group, start, end).distinct().withColumn("__reach", F.max(end).over(before))
    free = places.where(F.col("__reach").isNull() | (F.col("__reach") < F.col(end))).drop("__reach")
    return ranges.join(free, [*group, start, end], "left_semi")


def near_any(facts: DataFrame, lines: DataFrame, group: list[str], pos: str, reach: int = 1) -> DataFrame:
    """Facts within ``reach`` of a line of their group; groups without lines keep all their facts."""
    hits = lines.select(*group, F.explode(F.sequence(F.col(pos) - reach, F.col(pos) + reach)).alias(pos)).distinct()
    near = facts.join(hits, [*group, pos], "left_semi")
    return near.unionByName(facts.join(lines.select(*group).distinct(), group, "left_anti"))


def merged_facts(strong: DataFrame, weak: DataFrame, group: list[str], pos: str, kind: str, text: str, exclusive: bool = True) -> DataFrame:
    """Facts of two channels, one row for each (group, pos, kind).

    ``strong`` holds; ``weak`` (with ``ord``) snaps to a strong fact of its kind within two
    lines.  Where the key exists, a weak fact only gives its text, the last non-empty one;
    with ``exclusive``, one whose line holds strong facts of other kinds is dropped.
    """
    base = strong.groupBy(*group, pos, kind).agg(F.min_by(text, "ord").alias(text))
    placed = snap(weak, base.select(*group, kind, pos), [*group, kind], pos).drop(pos).withColumnRenamed("snapped", pos)
    texts = placed.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(*group, pos, kind).agg(F.max_by(text, "ord").alias("__t"))
    known = base.join(texts, [*group, pos, kind], "left").select(*group, pos, kind, F.coalesce("__t", text).alias(text), F.lit(True).alias("strong"))
    new = placed.join(base, [*group, pos, kind], "left_anti")
    if exclusive:
        new = new.join(base.select(*group, pos).distinct(), [*group, pos], "left_anti")
    added = new.groupBy(*group, pos, kind).agg(F.min_by(text, "ord").alias("__first"))
    added = added.join(texts, [*group, pos, kind], "left").select(*group, pos, kind, F.coalesce("__t", "__first").alias(text), F.lit(False).alias("strong"))
    return known.unionByName(added)

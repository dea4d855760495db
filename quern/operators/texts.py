"""Operators over texts as tables of lines: diffs, blocks, calls, markers, units.

Defined cases: a null text has no lines, an empty one a single empty line; lines are numbered
from 1 and must not repeat a number; a null key meets no line; empty tables give empty results.
Columns that begin with two underscores are the module's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key``, n (from 1) and line of each line."""
    return texts.select(*key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(*key, (F.col("p") + 1).alias("n"), "line")


def diff_hunks(lines: DataFrame, key: list[str], suffix: str = ".go", skip: str = r"(^|/)(testdata|vendor)/|_test\.") -> DataFrame:
    """file, start and header of each hunk of unified diffs, in order, of files with ``suffix`` that aren't tests; each (file, header) once."""
    order = Window.partitionBy(*key).orderBy("n")
    named = lines.withColumn("file", F.last(F.when(F.startswith("line", F.lit("+++ ")), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(order))
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@ ?(.*)$"
    hunks = named.where(F.col("line").rlike(pattern) & F.endswith("file", F.lit(suffix)) & ~F.col("file").rlike(skip))
    out = hunks.select(*key, "n", "file", F.regexp_extract("line", pattern, 1).cast("int").alias("start"), F.regexp_extract("line", pattern, 2).alias("header"))
    first = Window.partitionBy(*key, "file", "header").orderBy("n")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def diff_files(lines: DataFrame, key: list[str], suffix: str = ".go", skip: str = r"_test\.go$") -> DataFrame:
    """file and n (the line of its header) of each file with ``suffix`` that a unified diff touches, with or without hunks; each once."""
    before = F.lag("line").over(Window.partitionBy(*key).orderBy("n"))
    git, plain = F.regexp_extract("line", r"^diff --git a/.*? b/(.*)$", 1), F.when(F.startswith(before, F.lit("--- ")), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1))
    named = lines.select(*key, "n", F.coalesce(F.nullif(git, F.lit("")), F.nullif(plain, F.lit(""))).alias("file"))
    return named.where(F.endswith("file", F.lit(suffix)) & ~F.col("file").rlike(skip)).groupBy(*key, "file").agg(F.min("n").alias("n"))


def brace_depth(lines: DataFrame, key: list[str]) -> DataFrame:
    """Lines with depth: open less closed braces up to and with each line."""
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    order = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("depth", F.sum(count("{") - count("}")).over(order).cast("int"))


def function_blocks(lines: DataFrame, key: list[str], start: str = r"^func (?:\(\w+\s+\*?(\w+)(?:\[.*?\])?\)\s*)?(\w+)") -> DataFrame:
    """receiver, name, first, last line of each block that begins at a line like ``start`` and ends where its braces close."""
    deep = brace_depth(lines, key)
    heads = deep.where(F.col("line").rlike(start)).select(*key, F.col("n").alias("first"), F.regexp_extract("line", start, 1).alias("receiver"), F.regexp_extract("line", start, 2).alias("name"))
    order = Window.partitionBy(*key).orderBy("n")
    opened = deep.join(heads.select(*key, F.col("first").alias("n"), F.col("first").alias("__first")), [*key, "n"], "left")
    block = opened.withColumn("block", F.last("__first", ignorenulls=True).over(order)).where("block is not null")
    before = (F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit("")))) > 0
    closed = block.where(before & (F.col("depth") <= 0)).groupBy(*key, "block").agg(F.min("n").alias("last"))
    return heads.join(closed.withColumnRenamed("block", "first"), [*key, "first"]).select(*key, "receiver", "name", "first", "last")


def lines_between(lines: DataFrame, points: DataFrame, key: list[str], first: str, last: str) -> DataFrame:
    """``points`` with text: the lines from the number in column ``first`` to that in ``last``; points without lines drop.

    Each distinct place lists the line numbers it wants, so lines meet places by equality; points
    that repeat come out as often.  Files of texts are small beside the lines they hold, by which
    Spark can't judge what to broadcast: all is joined by sorting.
    """
    wanted = points.select(*key, first, last).distinct().select("*", F.explode(F.sequence(first, last)).alias("n"))
    found = wanted.join(lines.select(*key, "n", "line").hint("merge"), [*key, "n"]).groupBy(*key, first, last).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("__l"))
    found = found.select(*key, first, last, F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("text"))
    return points.join(found.hint("merge"), [*key, first, last]).select(*points.columns, "text")


def windows_around(lines: DataFrame, points: DataFrame, key: list[str], at: str, before: int, after: int) -> DataFrame:
    """``points`` with text: the lines from ``before`` above to ``after`` below each, as ``lines_between`` gives them."""
    placed = points.withColumn("__first", F.greatest(F.col(at) - before, F.lit(1))).withColumn("__last", F.col(at) + after)
    return lines_between(lines, placed, key, "__first", "__last").select(*points.columns, "text")


def called_names(text: Column) -> Column:
    """Distinct names followed by an opening parenthesis, less Go's keywords, in order of the alphabet."""
    names = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin("func", "if", "for", "switch", "return", "make", "len", "append", "panic", "go", "defer", "select"))))


def calls_in(text: Column) -> Column:
    """``pkg.Func`` of each dotted call in a text, once: the last two segments of its path; calls of one segment drop."""
    paths = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1))
    segments = F.transform(paths, lambda p: F.filter(F.split(p, r"\."), lambda s: s != ""))
    dotted = F.filter(segments, lambda s: F.size(s) >= 2)
    return F.array_distinct(F.transform(dotted, lambda s: F.array_join(F.slice(s, F.size(s) - 1, 2), ".")))


def markers(lines: DataFrame, key: list[str]) -> DataFrame:
    """One row for each (key, arm): reached, blocked_at, result (a map), observed, each from the arm's last line of the kind."""
    pattern = r"^\s*ARM=(benign|malicious)\s+(.*)$"
    arms = lines.where(F.col("line").rlike(pattern)).select(*key, "n", F.regexp_extract("line", pattern, 1).alias("arm"), F.trim(F.regexp_extract("line", pattern, 2)).alias("rest"))
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: F.contains(w, F.lit("=")))
    pairs = lambda t: F.map_from_entries(F.filter(F.transform(words(t), lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.substring(w, F.length(F.substring_index(w, "=", 1)) + 2, F.length(w)).alias("value"))), lambda x: x["key"] != ""))
    kind = F.when(F.startswith("rest", F.lit("REACHED=")), "reached").when(F.startswith("rest", F.lit("RESULT")), "result").when(F.startswith("rest", F.lit("OBSERVED=")), "observed")
    tagged = arms.withColumn("kind", kind)
    last = lambda k, v: F.max_by(F.when(F.col("kind") == k, v), F.when(F.col("kind") == k, F.col("n")))
    reach = pairs(F.col("rest"))
    return tagged.groupBy(*key, "arm").agg(
        last("reached", F.try_element_at(reach, F.lit("REACHED"))).alias("reached"), last("reached", F.try_element_at(reach, F.lit("BLOCKED_AT"))).alias("blocked_at"),
        F.coalesce(last("result", pairs(F.expr("substring(rest, 7)"))), F.create_map().cast("map<string,string>")).alias("result"),
        last("observed", F.expr("trim(substring(rest, 10))")).alias("observed"))


def unit_split(lines: DataFrame, key: list[str], boundary: Column, max_lines: int = 240, max_chars: int = 18000) -> DataFrame:
    """``key``, unit, first, last: consecutive pieces of each text.

    A piece ends before a boundary line if with that block it would pass a limit; a block
    above the limits is cut where they are reached.  This is a fold over the lines of one
    text, so it runs text by text.
    """
    import pandas as pd

    kinds = dict(lines.dtypes)

    def of_text(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        out, first, block, chars, block_chars = [], None, None, 0, 0
        last = None
        for n, size, starts in zip(pdf["n"], pdf["__size"], pdf["__starts"]):
            if first is None:
                first = block = n
            if starts:
                block, block_chars = n, 0
            if n - first + 1 > max_lines or chars + size > max_chars:
                cut = block if block > first else n
                out.append((first, cut - 1))
                first = cut
                chars = block_chars if cut == block else 0
                if cut != block:
                    block, block_chars = n, 0
            chars += size
            block_chars += size
            last = n
        if first is not None:
            out.append((first, last))
        head = [pdf[k].iloc[0] for k in key]
        return pd.DataFrame([(*head, i + 1, int(a), int(b)) for i, (a, b) in enumerate(out)], columns=[*key, "unit", "first", "last"])

    sized = lines.select(*key, "n", (F.length("line") + 1).alias("__size"), boundary.alias("__starts"))
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "unit int, first int, last int"])
    return sized.groupBy(*key).applyInPandas(of_text, ddl)


def capped(lines: DataFrame, key: list[str], max_chars: int = 18000) -> DataFrame:
    """The lines whose running length stays within the cap; truncated tells whether some are left out.

    A text whose first line alone is longer has one row, truncated, in which all but the key is null.
    """
    w = Window.partitionBy(*key)
    running = F.sum(F.length("line") + 1).over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    measured = lines.withColumn("__r", running).withColumn("truncated", F.max("__r").over(w) > max_chars).withColumn("__first", F.row_number().over(w.orderBy("n")) == 1)
    fits = F.col("__r") <= max_chars
    rest = [c for c in lines.columns if c not in key]
    return measured.where(fits | F.col("__first")).select(*key, *[F.when(fits, F.col(c)).alias(c) for c in rest], "truncated").select(*lines.columns, "truncated")

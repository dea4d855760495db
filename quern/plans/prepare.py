"""Records prepared from a patch: the functions it changes, each with its source around.

Defined cases: hunks without a header, and headers that name nothing, have no context; contexts of
blank lines drop; a file without lines has none; files that repeat count
once, where they come first; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import texts

# How a header or a line names what it begins; methods come before functions before types.
NAMED = r"^(?:func\s+(?:\(.*?\)\s+)?(\w+)\s*\(|type\s+(\w+)\s+)"
DEFINED = (r"^func\s+\(.*?\)\s+(\w+)\s*\(", r"^func\s+(\w+)\s*\(", r"^type\s+(\w+)\s+")


def contexts(hunks: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """``key``, n, file, function, source_context of each name that hunks change, once a file.

    ``hunks`` as ``texts.diff_hunks`` gives them; ``lines``: ``key``, file, n, line before the patch.
    The context is 25 lines from where the name is defined, else those from three above the hunk's
    start to fourteen below.
    """
    at = [*key, "file"]
    name = F.coalesce(*[F.nullif(F.regexp_extract("header", NAMED, i), F.lit("")) for i in (1, 2)])
    first = Window.partitionBy(*at, "name").orderBy("n")
    named = hunks.withColumn("name", name).where("name is not null").withColumn("__r", F.row_number().over(first)).where("__r = 1")
    named = named.select(*at, "name", F.col("n").alias("__n"), "start", "header")
    rank, word = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, pattern in reversed(list(enumerate(DEFINED))):
        rank, word = F.when(F.col("line").rlike(pattern), i).otherwise(rank), F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)).otherwise(word)
    heads = lines.select(*at, "n", rank.alias("rank"), word.alias("name")).where("rank is not null").groupBy(*at, "name").agg(F.min(F.struct("rank", "n"))["n"].alias("__at"))
    # joined by sorting: what Spark takes for the size of these tables is that of the files the patches come from
    placed = named.join(heads.hint("merge"), [*at, "name"], "left")
    placed = placed.withColumn("__first", F.coalesce("__at", F.greatest(F.col("start") - 3, F.lit(1)))).withColumn("__last", F.coalesce(F.col("__at") + 24, F.col("start") + 14))
    out = texts.lines_between(lines, placed, at, "__first", "__last").withColumn("text", F.regexp_replace("text", r"\s+$", ""))
    return out.where("text <> ''").select(*key, F.col("__n").alias("n"), "file", F.col("header").alias("function"), F.col("text").alias("source_context"))


def records(advisories: DataFrame, files: DataFrame, hunks: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Advisories with changed_files, changed_functions and func_source_contexts, all in the order of the patch.

    ``files`` as ``texts.diff_files`` gives them: a file counts whether it has hunks or not.  Advisories whose patch touches none drop.
    """
    in_order = lambda c: F.transform(F.array_sort(c), lambda x: x.dropFields("n"))
    changed = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "file"))).alias("__files"))
    named = hunks.where("header <> ''").groupBy(key).agg(in_order(F.collect_list(F.struct("n", "file", F.col("header").alias("function")))).alias("__functions"))
    around = found.groupBy(key).agg(in_order(F.collect_list(F.struct("n", "file", "function", "source_context"))).alias("__contexts"))
    return advisories.join(changed.hint("merge"), key).join(named.hint("merge"), key, "left").join(around.hint("merge"), key, "left").select(
        *advisories.columns, F.col("__files.file").alias("changed_files"), F.coalesce("__functions", F.array()).alias("changed_functions"), F.coalesce("__contexts", F.array()).alias("func_source_contexts"))

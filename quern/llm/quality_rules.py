"""Quality rules with thresholds that follow the data.

Fixed cutoffs give way to fences from quantile sketches.  For each metric, a sketch is a
histogram over logarithmic bins (relative error below 2 %); it is a table of counts by
language, source and bin, so sketches merge by adding counts, in any order, with the same
result, and a group is aggregated inside each task before anything moves.

The upper fence of a metric in a group is

    median + spread * max(upper quartile - median, slack of the metric)

where the group is (language, source) if it holds ``min_group`` documents, else the
language, else all documents: smaller groups take the merged sketch.  A document fails the
metrics that lie above their fences.  Metrics are shares, so that clean documents differ by
less than the slack whatever their length, and a fence moves up where a source is unlike
others as a whole, and never below the slack.

Metrics: symbols for each word; the share of content lines that repeat an earlier one; the
share of words in 5-word windows that occur again in the text; the mean length of words.

Defined cases: a null text has no words and fails the base rules; null languages and
sources are groups like others; repeated rows come out as often; no documents give no rows;
extra columns of any name are ignored.  A long text is held as its words and their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import SPACES, columns_of, words_of
from quern.operators.null_safe import null_safe_join
from quern.scratch import Scratch

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bins grow by this factor, so a bin's upper end is within 2 % of each value in it.
GAMMA = 1.02
FLOOR = 1e-4
#: Slack of each metric: its fence is at least ``spread`` times this above the median.
SLACK = {"symbols": 0.02, "dup_lines": 0.12, "repeats": 0.07, "word_length": 1.5}
WINDOW = 5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base numbers of each row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    docs = columns_of(docs, "doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    base = docs.select(
        "doc_id", "lang", "source", F.xxhash64("text").alias("th"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
    )
    grams = F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    base = base.select("doc_id", "lang", "source", "th", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"), grams.alias("g"),
                       F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"))
    # only texts with some equal windows are sorted
    some = F.size("g") > F.size(F.array_distinct("g"))
    sorted_grams = F.when(some, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.select("doc_id", "lang", "source", "th", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", sorted_grams.alias("s"))
    twice = F.filter(F.col("s"), lambda x, i: (F.get("s", i - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get("s", i + 1)["h"] == x["h"]).eqNullSafe(True))
    base = base.select("doc_id", "lang", "source", "th", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines",
                       F.when(F.size("s") > 0, F.sort_array(F.transform(twice, lambda x: x["i"]))).alias("p"))
    cover = F.aggregate(
        F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return base.select("doc_id", "lang", "source", "th", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", F.coalesce(cover, F.lit(0).cast("long")).alias("n_repeat_words"))


def _metrics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def _bin(value: Column) -> Column:
    """The bin of a value: 0 up to FLOOR, then one for each factor GAMMA."""
    return F.when(value <= FLOOR, 0).otherwise(F.ceil(F.log(value / FLOOR) / F.log(F.lit(GAMMA)))).cast("int")


def _value(bin_: Column) -> Column:
    """The upper end of a bin."""
    return F.when(bin_ == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), bin_) * FLOOR)


def sketches(numbers: DataFrame) -> DataFrame:
    """level, lang, source, metric, bin, n: of each (language, source), each language and all documents."""
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), _bin(v).alias("bin")) for m, v in _metrics().items()])
    leaves = numbers.select("lang", "source", F.explode(metrics).alias("m")).groupBy("lang", "source", "m.metric", "m.bin").agg(F.count("*").alias("n"))
    merged = leaves.select("metric", "bin", "n", F.explode(F.array(
        F.struct(F.lit(2).alias("level"), "lang", "source"),
        F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    )).alias("g"))
    return merged.groupBy("g.level", "g.lang", "g.source", "metric", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, spread: float, min_group: int) -> DataFrame:
    """lang, source, fence (a map by metric): of every group at every level with ``min_group`` documents, and of all."""
    # a group's bins are bounded by the metric's range, so they fit one array
    by_metric = sketch.groupBy("level", "lang", "source", "metric").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def quantile(q: float) -> Column:
        # the first bin whose running count reaches q of the total
        found = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bin"].isNull() & ((a["seen"] + x["n"]) >= F.col("total") * q), x["bin"]).otherwise(a["bin"]).alias("bin")),
            lambda a: a["bin"])
        return _value(found)

    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])
    measured_ = by_metric.where(f"total >= {min_group} or level = 0").select(
        "level", "lang", "source", "metric", quantile(0.5).alias("mid"), quantile(0.75).alias("high"))
    fence = F.col("mid") + spread * F.greatest(F.col("high") - F.col("mid"), slack[F.col("metric")])
    return measured_.groupBy("level", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", fence.alias("fence")))).alias("fence"))


def judged(docs: DataFrame, scratch: Scratch, spread: float = 3.0, min_group: int = 200) -> DataFrame:
    """The base numbers of each row with base_failed, failed (the metrics above their fences) and kept."""
    numbers = scratch.cut(measured(docs), "numbers")
    groups = scratch.cut(fences(sketches(numbers), spread, min_group), "fences")
    overall = groups.where("level = 0").first()  # one row: the fences of all documents
    every = numbers.select("lang", "source").distinct()
    at = lambda level, *on: groups.where(f"level = {level}").select(*on, F.col("fence").alias(f"fence{level}"))
    every = null_safe_join(every, at(2, "lang", "source"), ["lang", "source"], "left")
    chosen = null_safe_join(every, at(1, "lang"), ["lang"], "left")
    of_all = F.create_map(*[F.lit(x) for pair in (overall["fence"] if overall else dict.fromkeys(SLACK, 0.0)).items() for x in pair])
    chosen = chosen.select("lang", "source", F.coalesce("fence2", "fence1", of_all).alias("fence"))
    joined = null_safe_join(numbers, chosen, ["lang", "source"], "left")
    failed = F.array_compact(F.array(*[F.when(v > F.col("fence")[m], F.lit(m)) for m, v in _metrics().items()]))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select(*numbers.columns, base_failed.alias("base_failed"), failed.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))


def filtered(docs: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    named = ("doc_id", "th", "lang", "source")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", "row.doc_id", F.xxhash64("row.text").alias("th"), "row.lang", "row.source")
    kept = judged(docs, scratch, **settings).where("kept").select(*named).distinct()
    return null_safe_join(keyed, kept, list(named), "left_semi").select("row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB, by the words themselves and with the same bins.
OP3_SQL = """
WITH W AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
X AS (SELECT doc_id, p, list_slice(w, p, p + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM W WHERE len(w) >= 5)),
Y AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS k FROM X),
R AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM (SELECT doc_id, p, unnest(range(0, 5)) AS j FROM Y WHERE k > 1) GROUP BY doc_id),
N AS (SELECT W.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(R.n, 0) AS n_repeat_words
    FROM W LEFT JOIN R ON R.doc_id = W.doc_id),
V AS (SELECT doc_id, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric,
    unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) AS v FROM N),
B AS (SELECT *, CASE WHEN v <= 1e-4 THEN 0 ELSE CAST(ceil(ln(v / CAST(1e-4 AS DOUBLE)) / ln(CAST(1.02 AS DOUBLE))) AS INTEGER) END AS bin FROM V),
H AS (SELECT 2 AS level, lang, source, metric, bin, count(*) AS n FROM B GROUP BY ALL UNION ALL SELECT 1, lang, NULL, metric, bin, count(*) FROM B GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, metric, bin, count(*) FROM B GROUP BY ALL),
C AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM H),
Q AS (SELECT level, lang, source, metric, min(bin) FILTER (seen >= total * 0.5) AS mid, min(bin) FILTER (seen >= total * 0.75) AS high, max(total) AS total FROM C GROUP BY ALL),
D AS (SELECT level, lang, source, metric, total, CASE WHEN mid = 0 THEN 0.0 ELSE pow(CAST(1.02 AS DOUBLE), mid) * 1e-4 END AS mid, CASE WHEN high = 0 THEN 0.0 ELSE pow(CAST(1.02 AS DOUBLE), high) * 1e-4 END AS high FROM Q),
F AS (SELECT level, lang, source, metric, mid + 3.0 * greatest(high - mid, CASE metric WHEN 'symbols' THEN 0.02 WHEN 'dup_lines' THEN 0.12 WHEN 'repeats' THEN 0.07 ELSE 1.5 END) AS fence FROM D WHERE total >= 200 OR level = 0),
J AS (SELECT v.doc_id, count(*) FILTER (v.v > coalesce(a.fence, b.fence, c.fence)) AS failed FROM V v
    LEFT JOIN F a ON a.level = 2 AND a.metric = v.metric AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
    LEFT JOIN F b ON b.level = 1 AND b.metric = v.metric AND b.lang IS NOT DISTINCT FROM v.lang
    JOIN F c ON c.level = 0 AND c.metric = v.metric GROUP BY v.doc_id)
SELECT N.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND failed = 0 AS kept
FROM N JOIN J ON J.doc_id = N.doc_id
"""


def brute_base(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) by plain loops; for tests."""
    import re
    from collections import Counter

    out = []
    for doc_id, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i : i + WINDOW]) for i in range(len(w) - WINDOW + 1))
        again = {j for i in range(len(w) - WINDOW + 1) if windows[tuple(w[i : i + WINDOW])] > 1 for j in range(i, i + WINDOW)}
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(again), failed))
    return out

"""Line dedup: repeated three-line windows.

The lines of a text that hold a word are its content lines.  A window is ``window``
consecutive content lines of one document, whatever blank lines lie between; it is
compared by a 128-bit hash of its lines.  Of all windows with one hash, the first by
(doc_id, text hash, position) stays; the lines that any other covers are removed, covered
positions merged.  Blank lines next to removed lines stay.

Only hashes and positions move until the end: windows are aggregated to their first
occurrence with map-side partial aggregation, so a window that fills a third of all rows
is one row a task; the join back meets such a key by splitting its rows (adaptive skew
join).  Positions come together by document, bounded by its lines.

Defined cases: a text with fewer content lines than a window has none and stays as it is;
so does a null text; a null doc_id comes after all others; rows that repeat doc_id and text
are one document and come out alike; no documents give no rows; other columns, of any name,
pass through.  A long text is held as the array of its lines; its windows are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import SPACES, columns_of
from quern.scratch import Scratch


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(SPACES))) > 0


def _key(doc_id: Column, text: Column) -> Column:
    """Documents in order: null ids last, then the hash of the text."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(text).alias("th"))


def windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """k (the document's key), p (number of its first content line), at (its lines' positions) and h1, h2 of every window."""
    content = F.filter(
        F.transform(_lines("text"), lambda x, i: F.when(_has_word(x), F.struct(i.alias("i"), F.xxhash64(x, F.lit(1)).alias("a"), F.xxhash64(x, F.lit(2)).alias("b")))),
        lambda s: s.isNotNull(),
    )
    content = docs.select(_key(F.col("doc_id"), F.col("text")).alias("k"), content.alias("c")).where(F.size("c") >= window)
    starts = content.select("k", "c", F.posexplode(F.sequence(F.lit(0), F.size("c") - window)).alias("p", "start"))
    each = starts.select("k", "p", F.slice("c", F.col("p") + 1, window).alias("w"))
    return each.select("k", "p", F.col("w.i").alias("at"), F.xxhash64("w.a").alias("h1"), F.xxhash64("w.b").alias("h2"))


def repeated(docs: DataFrame, scratch: Scratch, window: int = 3) -> DataFrame:
    """k and gone: for each document with windows that are not first occurrences, the positions of the lines they cover."""
    seen = scratch.cut(windows(docs, window), "windows")
    first = seen.groupBy("h1", "h2").agg(F.min(F.struct("k", "p")).alias("f"), F.max(F.struct("k", "p")).alias("l")).where("f < l").select("h1", "h2", "f")
    later = seen.join(first, ["h1", "h2"]).where(F.struct("k", "p") > F.col("f"))
    return later.select("k", F.explode("at").alias("i")).groupBy("k").agg(F.collect_set("i").alias("gone"))


def dedup_lines(docs: DataFrame, scratch: Scratch, window: int = 3, counts: str | None = None) -> DataFrame:
    """The rows of ``docs`` with their text deduplicated.

    ``counts`` names a further column, which ``docs`` must not have: the struct of n (content lines) and removed.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    packed = packed.select("row", _key(F.col("row.doc_id"), F.col("row.text")).alias("k"))
    with Scratch(docs.sparkSession) as inner:
        gone = scratch.cut(repeated(columns_of(docs, "doc_id", "text"), inner, window), "gone")
    # what is repeated grows with the input: a join by shuffle at any size
    split = packed.join(gone.hint("merge"), "k", "left").select("row", "gone", _lines("row.text").alias("all"))
    # both references to the split lines read one evaluated column
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone")), lambda i: F.element_at("all", i + 1))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    found = F.struct(
        F.coalesce(F.size(F.filter("all", _has_word)), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed"),
    )
    out = [text.alias(n) if n == "text" else F.col(f"row.`{n}`").alias(n) for n in names]
    return split.select(*out, *([found.alias(counts)] if counts else []))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and n_removed (content lines), kept_sha256 (of the text that stays) of every document."""
    out = dedup_lines(columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), Scratch(spark), counts="lines")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.removed").alias("n_removed"), kept.alias("kept_sha256"))


#: The same in DuckDB, by the lines themselves instead of their hashes; documents have distinct ids there.
OP2_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents
), marked AS (
    SELECT doc_id, i, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS w FROM lines
), content AS (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM marked WHERE w
), win AS (
    SELECT doc_id, p, concat(line, chr(10), lead(line, 1) OVER d, chr(10), lead(line, 2) OVER d) AS three, lead(line, 2) OVER d AS third
    FROM content WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), later AS (
    SELECT doc_id, p FROM (
        SELECT doc_id, p, row_number() OVER (PARTITION BY three ORDER BY doc_id, p) AS o FROM win WHERE third IS NOT NULL)
    WHERE o > 1
), gone AS (
    SELECT DISTINCT c.doc_id, c.i FROM later l JOIN content c ON c.doc_id = l.doc_id AND c.p BETWEEN l.p AND l.p + 2
), kept AS (
    SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.i) AS text
    FROM marked m ANTI JOIN gone g ON m.doc_id = g.doc_id AND m.i = g.i GROUP BY m.doc_id
), counts AS (
    SELECT doc_id, count(*) FILTER (w) AS n FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d
LEFT JOIN counts c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], thash, window: int = 3) -> list[tuple]:
    """(doc_id, n_lines, n_removed, text) by comparing lines; ``thash(text)`` orders texts of one id.  For tests."""
    key = lambda r: (r[0] is None, r[0] or 0, thash(r[1]) if r[1] is not None else 42)
    first: dict[tuple, tuple] = {}
    content = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(SPACES)] for _, t in rows]
    for r, c in zip(rows, content):
        for p in range(len(c) - window + 1):
            w = tuple(x for _, x in c[p : p + window])
            first[w] = min(first.get(w, (key(r), p)), (key(r), p))
    out = []
    for r, c in zip(rows, content):
        gone = set()
        for p in range(len(c) - window + 1):
            if (key(r), p) > first[tuple(x for _, x in c[p : p + window])]:
                gone.update(i for i, _ in c[p : p + window])
        text = "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone) if r[1] is not None else None
        out.append((r[0], len(c), len(gone), text))
    return out

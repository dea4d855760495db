"""Document fingerprints by winnowing.

A text's ``k``-grams of code points get rolling (polynomial, mod 2^64) hashes; of every
``window`` consecutive ones the smallest is selected, the rightmost of ties, and kept with
its position.  So any two texts that share ``window + k - 1`` code points share a selected
hash at a known place, and nothing shorter than ``k`` counts.  A text with fewer k-grams
than a window selects its one smallest; one shorter than ``k`` is a single short gram; an
empty text selects nothing.

Likeness of two fingerprints is the Jaccard index of their sets of hashes (1 if both are
empty).

Edited texts need the *next* document by doc_id.  Documents are range-partitioned and sorted
by (doc_id, hash of the text, number of the row), so that no doc_id, however often it comes, is
one partition.  Each partition pairs its neighbours as they stream by, and puts out its first and
last rows beside them.  Those meet by the number of their partition: the last row of one and the
first of the next that isn't empty, and of all, the last and the first.

Defined cases: a null text is empty; null doc_ids come first in the order; rows with equal
doc_id are ordered by the hash of their text; a single document follows itself; no documents
give no rows; other columns, of any name, are ignored.  A text is held whole, at some 50 bytes
for each code point, two at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.hashing import mix
from quern.llm.text import columns_of
from quern.scratch import Scratch

K, WINDOW = 25, 40
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and those of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 15)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _powers[name] = np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base))).cumprod(dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """The hash of each k-gram: prefix sums of code points times powers, brought back to power 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    up, down = _power(len(points))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * up, dtype=np.uint64)))
    return mix((sums[k:] - sums[:-k]) * down[: len(points) - k + 1] + np.uint64(k))


def select(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window, rightmost of ties, each once."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    at, low, span = np.arange(n), hashes, 1  # of the span of windows that begins at each place
    while span < window:
        step = min(span, window - span)
        right, right_at = low[step:], at[step:]
        low, at = low[: len(right)], at[: len(right)]
        take = right <= low
        low, at = np.where(take, right, low), np.where(take, right_at, at)
        span += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    hashes = gram_hashes(text, k)
    at = select(hashes, window)
    return hashes[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two arrays of distinct hashes, each sorted."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def digest(hashes: np.ndarray, at: np.ndarray) -> str:
    """Of all selected hashes and positions: equal if and only if these are, but for collisions."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + at.astype("<i8").tobytes(), digest_size=16).hexdigest()


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of every row's fingerprint."""

    def of_batches(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                prints = [fingerprint(t or "", k, window) for t in rows["text"].to_pylist()]
                hashes, places = pa.array([h.view(np.int64) for h, _ in prints], pa.list_(pa.int64())), pa.array([p for _, p in prints], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], hashes, places], ["doc_id", "hashes", "positions"])

    docs = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(of_batches, "doc_id long, hashes array<long>, positions array<long>")


def in_order(docs: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """doc_id and text in the order of the module's text, by ranges of some ``partition_bytes`` in the mean."""
    docs = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // partition_bytes))
    # rows that share doc_id and text are the same to their neighbours, whatever their numbers
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("n"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("n")]
    return keyed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("doc_id", "text")


RESULT, FIRST, LAST = 0, 1, 2  # kinds of rows that a partition puts out


def _pair(now: tuple, following: tuple, k: int, window: int) -> tuple:
    """The result of a row; both rows are (doc_id, text, fingerprint of the text)."""
    (doc_id, text, mine), (_, after, theirs) = now, following
    changed = edited(text, after)
    other = mine if changed == text else fingerprint(changed, k, window)
    sets = [np.unique(h) for h, _ in (mine, other, theirs)]
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(*mine), digest(*other), likeness(sets[0], sets[1]), likeness(sets[0], sets[2])


def with_edits(docs: DataFrame, scratch: Scratch, k: int = K, window: int = WINDOW, partition_bytes: int = 64 << 20) -> DataFrame:
    """Each row's text and edited text, fingerprinted: see ``op5_fingerprints``."""

    def neighbours(batches):
        part, none = TaskContext.get().partitionId(), (None,) * (len(_SCHEMA) - 1)
        before, rows = None, []

        def edge(kind: int, row: tuple) -> tuple:
            return row[0], *none, part, kind, row[1]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WITH_EDGES.types)], schema=_WITH_EDGES)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                now = (doc_id, text or "", fingerprint(text or "", k, window))
                rows.append(edge(FIRST, now) if before is None else (*_pair(before, now, k, window), part, RESULT, None))
                before = now
                if len(rows) >= 500:
                    yield flush()
        if before is not None:
            rows.append(edge(LAST, before))
            yield flush()

    def across(batches):
        for batch in batches:
            rows = []
            for doc_id, text, after in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "after"))):
                texts = [(doc_id, t, fingerprint(t, k, window)) for t in (text, after)]
                rows.append(_pair(*texts, k, window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)] if rows else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)

    made = scratch.cut(in_order(docs, partition_bytes).mapInArrow(neighbours, f"{OUT}, part int, kind int, text string"), "neighbours", rows_per_batch=500)
    first = made.where(F.col("kind") == FIRST).select("part", F.col("text").alias("after"))
    last = made.where(F.col("kind") == LAST).select("part", "doc_id", "text")
    # one row for each partition
    parts = Window.orderBy("part")
    of_all = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = first.select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(of_all)).alias("next"))
    ends = last.join(order, "part").select("doc_id", "text", "next").join(first.withColumnRenamed("part", "next"), "next")
    return made.where(F.col("kind") == RESULT).select(*_SCHEMA.names).unionByName(ends.select("doc_id", "text", "after").mapInArrow(across, OUT))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_WITH_EDGES = pa.schema([*_SCHEMA, ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))


def brute_force(rows: list[tuple[int | None, str | None]], thash, k: int = K, window: int = WINDOW) -> list[tuple]:
    """The same by sorting all rows and scanning every window; ``thash(text)`` orders texts of one id.  For tests."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, thash(r[1])))

    def selected(text):
        h = gram_hashes(text, k).tolist()
        w = min(window, len(h))
        at = sorted({max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)}) if h else []
        return np.array([h[j] for j in at], np.uint64), np.array(at, np.int64)

    def jaccard(a, b):
        a, b = set(a[0].tolist()), set(b[0].tolist())
        return len(a & b) / len(a | b) if a | b else 1.0

    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = edited(text, after)
        a, b, c = selected(text), selected(changed), selected(after)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(*a), digest(*b), jaccard(a, b), jaccard(a, c)))
    return out

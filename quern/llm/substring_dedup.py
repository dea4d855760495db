"""Substring dedup over documents with difference-cover anchors.

A *window* is ``window`` consecutive words of one document.  A word goes if it lies in a
window whose word sequence also starts in a document with a smaller doc_id.

Hashing every window and sending it would move a hash for each word.  Instead only
*anchors* travel first: shorter runs of ``window - period + 1`` words at positions whose
remainder modulo ``period`` is in a difference cover.  For any two positions there is a
shift below ``period`` that brings both onto the cover, so two equal windows share an
equal, aligned anchor inside them.  Where no anchor is shared, no window can be.  Around
shared anchors the match is extended: whole windows are hashed and compared.

Defined cases: null or empty text has no words; a null doc_id counts as larger than any
other; rows with one doc_id never remove each other's words; equal ids and repeated rows come
out as often; no documents give no rows; other columns are ignored.  A text longer than a
chunk is worked on whole, at some 60 bytes for each of its bytes.  Windows compare by 96 bits
of hash over all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange as X
from quern.llm.hashing import gram_checks, gram_hashes, gram_starts, word_hashes
from quern.scratch import Scratch

#: Difference covers by period: every remainder is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
_LAST = np.iinfo(np.int64).max
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
ANCHORS, WINDOWS = 0, 1  # parts of the exchange


class _Chunk:
    """The words, anchors and candidate windows of one chunk."""

    def __init__(self, ids: list, texts: list[bytes], window: int, period: int):
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        self.texts = texts
        self.words, self.checks, self.offsets = word_hashes(texts)
        self.window, self.period, self.run = window, period, window - period + 1
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.offsets))

    def _distinct(self, at: np.ndarray, n: int) -> X.Distinct:
        return X.Distinct(gram_hashes(self.words, n)[at], gram_checks(self.checks, n)[at])

    def anchors(self) -> tuple[np.ndarray, X.Distinct]:
        """Positions of the anchors, and what they hold."""
        fits = gram_starts(self.offsets, self.run)
        place = np.arange(len(fits)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))[: len(fits)]
        on = np.zeros(self.period, bool)
        on[list(COVERS[self.period])] = True
        at = np.flatnonzero(fits & on[place % self.period])
        return at, self._distinct(at, self.run)

    def in_two(self, at: np.ndarray, held: X.Distinct) -> np.ndarray:
        """For each anchor, 1 if documents with different ids of this chunk hold it."""
        low, high = np.full(len(held), _LAST), np.full(len(held), np.iinfo(np.int64).min)
        ids = self.ids[self.doc[at]]
        np.minimum.at(low, held.number, ids)
        np.maximum.at(high, held.number, ids)
        return (low < high).astype(np.int64)

    def windows(self, answers: pa.Table) -> tuple[np.ndarray, X.Distinct]:
        """Windows around the anchors that are shared: positions, and what they hold."""
        at, held = self.anchors()
        shared_at = at[X.laid_out(answers, ANCHORS)[held.number] > 0]
        del held
        fits = gram_starts(self.offsets, self.window)
        at = np.flatnonzero(fits & _covered(shared_at - self.period + 1, self.period, len(self.words))[: len(fits)])
        return at, self._distinct(at, self.window)

    def smallest(self, at: np.ndarray, held: X.Distinct) -> np.ndarray:
        low = np.full(len(held), _LAST)
        np.minimum.at(low, held.number, self.ids[self.doc[at]])
        return low


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` from one of ``starts`` on."""
    steps = np.bincount(np.maximum(starts, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = 13, period: int = 7, chunk_bytes: int = X.CHUNK_BYTES, bucket_bytes: int = 2 * X.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space), a row for each row of ``docs``."""
    chunks, size, _ = X.in_chunks(docs, scratch, chunk_bytes)
    buckets = X.buckets_of(chunks, size, bucket_bytes)

    def ask_anchors(batches):
        for batch in batches:
            for number, ids, texts in X.opened(batch):
                chunk = _Chunk(ids, texts, window, period)
                at, held = chunk.anchors()
                yield X.requests(number, ANCHORS, held, chunk.in_two(at, held), buckets)

    def shared(first, in_two):
        """1 for an anchor of two chunks, or of two ids in one; more than are needed, where chunks share an id."""
        return ((np.diff(first, append=len(in_two)) > 1) | np.maximum.reduceat(in_two, first).astype(bool)).astype(np.int64)

    def ask_windows(key, table, answers):
        asked = [X.requests(0, WINDOWS, X.Distinct(np.zeros(0, np.uint64), np.zeros(0, np.uint32)), np.zeros(0, np.int64), buckets)]
        for number, ids, texts in X.opened(table):
            chunk = _Chunk(ids, texts, window, period)
            at, held = chunk.windows(answers)
            asked.append(X.requests(number, WINDOWS, held, chunk.smallest(at, held), buckets))
        return pa.Table.from_batches(asked)

    def smallest_id(first, ids):
        return np.minimum.reduceat(ids, first)

    def finish(key, table, answers):
        rows = []
        for _, ids, texts in X.opened(table):
            chunk = _Chunk(ids, texts, window, period)
            at, held = chunk.windows(answers)
            gone = at[X.laid_out(answers, WINDOWS)[held.number] < chunk.ids[chunk.doc[at]]]
            stays = ~_covered(gone, window, len(chunk.words))
            for doc_id, text, a, b in zip(ids, texts, chunk.offsets, chunk.offsets[1:]):
                kept, words = stays[a:b], text.split()
                if not kept.all():
                    words = [words[j] for j in np.flatnonzero(kept)]
                rows.append((doc_id, int(b - a), int(b - a) - len(words), b" ".join(words).decode()))
        return pa.table([list(c) for c in zip(*rows)] or [[]] * 4, schema=_OUT)

    def with_answers(answers: DataFrame):
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))

    anchors = scratch.cut(X.answered(chunks.mapInArrow(ask_anchors, X.REQUEST), shared), "anchors", rows_per_batch=1)
    windows = scratch.cut(X.answered(with_answers(anchors).applyInArrow(ask_windows, X.REQUEST), smallest_id), "windows")
    return with_answers(anchors.unionByName(windows)).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, Scratch(spark))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, by the words of the windows themselves; documents have distinct ids there.
OP9_SQL = """
WITH W AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
X AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM W WHERE len(w) >= 13),
Y AS (SELECT doc_id, p, list_slice(w, p, p + 12) AS g FROM X),
M AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS m FROM Y),
G AS (SELECT DISTINCT doc_id, p + k AS p FROM (SELECT doc_id, p, unnest(range(0, 13)) AS k FROM M WHERE m < doc_id)),
E AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM W),
K AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM E ANTI JOIN G USING (doc_id, p) GROUP BY doc_id),
R AS (SELECT doc_id, count(*) AS n FROM G GROUP BY doc_id)
SELECT W.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(R.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(K.kept, '')) AS kept_sha256
FROM W LEFT JOIN K ON K.doc_id = W.doc_id LEFT JOIN R ON R.doc_id = W.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    """The same by comparing word sequences; for tests."""
    first: dict[tuple, int] = {}
    words = [(t or "").encode().split() for _, t in rows]
    ids = [_LAST if i is None else i for i, _ in rows]
    for i, w in zip(ids, words):
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for (doc_id, _), i, w in zip(rows, ids, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out

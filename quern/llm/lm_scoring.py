"""Stupid-backoff language-model scores of whole documents against the whole corpus.

Counts of word n-grams of orders 1 to ``order`` are taken over all documents, in tables
partitioned by n-gram hash.  A document is scored by the counts that the *other* rows
leave, c'(g) = c(g) - c_d(g), so that it doesn't vouch for itself:

    S(w | context) = c'(context w) / c'(context)   if c'(context w) > 0
                     alpha * S(w | shorter context) otherwise,
    S(w)           = c'(w) / N'                    if c'(w) > 0, else 1 / (N' + 1).

A document's score is the sum of ln S over its words.  Each chunk of documents explodes
its n-grams and counts them; the counts go to the tables, which are partitioned by hash,
and the totals come back joined to the chunk's n-grams (exchange.py), from there to its
positions, and are summed per document.  The two joins carry packed arrays, for a row for
each n-gram would be several times the input.  Orders go one after another, those above the
first in ``slices`` of the hash, so that few n-grams are on their way at once.

Defined cases: null or empty text has no words, logprob 0 and no mean; repeated rows
count as rows of their own; no documents give no rows; other columns are ignored.  A text
longer than a chunk is worked on whole, at some 60 bytes for each of its bytes.  N-grams are
told apart by 96 bits of hash.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange as X
from quern.llm.hashing import gram_checks, gram_hashes, gram_starts, word_hashes
from quern.scratch import Scratch

OUT = "doc_id long, n_words long, logprob double, mean_logprob double, n_backed_off long, n_unseen long"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("logprob", pa.float64()), ("mean_logprob", pa.float64()), ("n_backed_off", pa.int64()), ("n_unseen", pa.int64())])


class _Chunk:
    """The word n-grams of one chunk."""

    def __init__(self, texts: list[bytes]):
        self.words, self.checks, self.offsets = word_hashes(texts)

    def grams(self, n: int, slice_: tuple[int, int]) -> tuple[np.ndarray, X.Distinct]:
        """Start positions of the n-grams of slice (k, of so many) of the hash, and what they hold."""
        at, hashes = np.flatnonzero(gram_starts(self.offsets, n)), gram_hashes(self.words, n)
        k, of = slice_
        if of > 1:  # by low bits: buckets go by the high ones
            at = at[hashes[at] % np.uint64(of) == np.uint64(k)]
        return at, X.Distinct(hashes[at], gram_checks(self.checks, n)[at])


def _own_counts(number: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How often each position's n-gram occurs in the position's own document."""
    _, pair, count = np.unique(number.astype(np.int64) * docs + doc, return_inverse=True, return_counts=True)
    return count[pair]


def score(docs: DataFrame, scratch: Scratch, order: int = 3, alpha: float = 0.4, chunk_bytes: int = X.CHUNK_BYTES, bucket_bytes: int = X.BUCKET_BYTES, slices: int = 2) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, logprob, mean_logprob, words scored below the highest order they could have, words unseen elsewhere."""
    chunks, size, n_words_all = X.in_chunks(docs, scratch, chunk_bytes)
    buckets = X.buckets_of(chunks, size, bucket_bytes)
    # (order, slice of the hash): each is a pass
    parts = [(1, (0, 1))] + [(n, (k, slices)) for n in range(2, order + 1) for k in range(slices)]

    def ask(part):
        def of_batches(batches):
            for batch in batches:
                for number, _, texts in X.opened(batch):
                    _, held = _Chunk(texts).grams(*parts[part])
                    yield X.requests(number, part, held, held.count, buckets)

        return chunks.mapInArrow(of_batches, X.REQUEST)

    def total(first, counts):
        return np.add.reduceat(counts, first)

    def scored(ids, texts, answers):
        chunk = _Chunk(texts)
        offsets, sizes = chunk.offsets, np.diff(chunk.offsets)
        n_docs, n_words = len(texts), int(offsets[-1])
        doc = np.repeat(np.arange(n_docs), sizes)
        left = np.zeros((order, n_words), np.int64)  # of each n-gram, by its start: how often other documents have it
        for part, (n, slice_) in enumerate(parts):
            at, held = chunk.grams(n, slice_)
            totals = X.laid_out(answers, part)[held.number]
            twice = np.flatnonzero(totals > 1)
            own = _own_counts(held.number[twice], doc[at[twice]], n_docs)
            left[n - 1][at[twice]] = totals[twice] - own
        others = n_words_all - sizes[doc]
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(left[0] > 0, np.log(left[0] / np.maximum(others, 1)), -np.log(others + 1.0))
            level = np.ones(n_words, np.int8)
            for n in range(2, order + 1):
                start = np.flatnonzero(gram_starts(offsets, n))
                end, seen = start + n - 1, left[n - 1][start] > 0
                high = np.log(left[n - 1][start] / left[n - 2][start])
                s[end] = np.where(seen, high, s[end] + math.log(alpha))
                level[end[seen]] = n
        could = np.minimum(np.arange(n_words) - np.repeat(offsets[:-1], sizes) + 1, order)
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
        logprob = [float(s[a:b].sum()) for a, b in zip(offsets, offsets[1:])]
        mean = [x / k if k else None for x, k in zip(logprob, sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(logprob), pa.array(mean, pa.float64()), pa.array(sums(level < could)), pa.array(sums((level == 1) & (left[0] == 0)))], schema=_OUT)

    tables = [scratch.cut(X.answered(ask(part), total), "counts", rows_per_batch=1) for part in range(len(parts))]
    answers = reduce(DataFrame.unionByName, tables)

    def finish(key, table, answers):
        return pa.Table.from_batches([scored(ids, texts, answers) for _, ids, texts in X.opened(table)], schema=_OUT)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, OUT)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The scores of all documents; sums rounded where the order of addition shows."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return out.withColumns({"logprob": F.round("logprob", 4), "mean_logprob": F.round("mean_logprob", 6)})


#: The same in DuckDB, by the words of the n-grams; documents have distinct ids there.
OP10_SQL = """
WITH W AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
E AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS p, len(w) AS n FROM W),
G AS (SELECT *, lag(a) OVER d AS b, lag(a, 2) OVER d AS c FROM E WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
C AS (SELECT doc_id, p, n, sum(1) OVER () - n AS others,
    count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS c1,
    count(*) OVER (PARTITION BY b, a) - count(*) OVER (PARTITION BY doc_id, b, a) AS c2,
    count(*) OVER (PARTITION BY c, b, a) - count(*) OVER (PARTITION BY doc_id, c, b, a) AS c3 FROM G),
L AS (SELECT *, lag(c1) OVER d AS k1, lag(c2) OVER d AS k2 FROM C WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
S AS (SELECT doc_id, CASE
    WHEN p >= 3 AND c3 > 0 THEN ln(c3 / k2)
    WHEN p >= 2 AND c2 > 0 THEN ln(c2 / k1) + CASE WHEN p >= 3 THEN ln(0.4) ELSE 0 END
    WHEN c1 > 0 THEN ln(c1 / others) + least(p - 1, 2) * ln(0.4)
    ELSE -ln(others + 1) + least(p - 1, 2) * ln(0.4) END AS s,
    NOT (p = 1 OR CASE WHEN p = 2 THEN c2 > 0 ELSE c3 > 0 END) AS backed,
    c1 = 0 AND NOT (p >= 2 AND c2 > 0) AS unseen FROM L),
T AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (backed) AS b, count(*) FILTER (unseen) AS u FROM S GROUP BY doc_id)
SELECT W.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS logprob,
    CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_logprob, CAST(coalesce(b, 0) AS BIGINT) AS n_backed_off, CAST(coalesce(u, 0) AS BIGINT) AS n_unseen
FROM W LEFT JOIN T ON T.doc_id = W.doc_id
"""


def brute_force(rows: list[tuple[int | None, str | None]], order: int = 3, alpha: float = 0.4) -> list[tuple]:
    """The same with dictionaries of word tuples; for tests."""
    texts = [(t or "").encode().split() for _, t in rows]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    count = [Counter(g for w in texts for g in grams(w, n)) for n in range(1, order + 1)]
    size = sum(map(len, texts))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        own = [Counter(grams(w, n)) for n in range(1, order + 1)]
        c = lambda g: count[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731,B023
        logprob, backed, unseen = 0.0, 0, 0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    logprob += math.log(c(g) / (c(g[:-1]) if n > 1 else size - len(w)))
                    break
                if n > 1:
                    logprob += math.log(alpha)
                else:
                    logprob += -math.log(size - len(w) + 1)
                    unseen += 1
            backed += n < top
        out.append((doc_id, len(w), logprob, logprob / len(w) if w else None, backed, unseen))
    return out

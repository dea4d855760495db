"""Global facts about hashes, asked for by chunks of documents.

A *chunk* is one row that holds whole documents, some ``chunk_bytes`` of text (a longer
document is a chunk of its own), compressed.  Chunks are written once, so that each later pass reads the
same ones, whichever executors are lost between; rows fall into them as they are read, so no
key, however hot, makes one large.

A chunk sorts its distinct hashes and asks once for each, however often it holds it (the
map-side combine: a hash that fills a third of all rows is one entry a chunk).  Requests go
to *buckets*, which are ranges of the hash, as packed arrays; a bucket answers each request in
its own order, so that an answer needs no address but (chunk, bucket).  The chunk, which
recomputes its sorted hashes, lays the answers of its buckets end to end.

Both sizes are fixed; an input twice as large has twice as many of each.  A request then
holds fewer hashes, in the limit one, a plain row of a join by hash.  A worker holds some 60
bytes for each byte of a chunk's text or of a bucket's share of it; besides, a hash that every
chunk holds gives its bucket an entry of 80 bytes a chunk (20 MB a TB of text at 4 MB a chunk).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.hashing import n_words
from quern.llm.text import columns_of
from quern.scratch import Scratch

CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
CHUNK = "chunk long, bytes long, words long, raw long, body binary"
REQUEST = "chunk long, bucket long, part int, n int, body binary"
ANSWER = "chunk long, bucket long, part int, answer binary"
_CHUNK = pa.schema([("chunk", pa.int64()), ("bytes", pa.int64()), ("words", pa.int64()), ("raw", pa.int64()), ("body", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
_REQUEST = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("part", pa.int32()), ("answer", pa.binary())])


def in_chunks(docs: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """The documents as chunks, a row each, and the bytes and words of all texts; a null text is empty, repeated rows stay."""
    docs = columns_of(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def of_batches(batches):
        numbered, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed():
            docs = pa.RecordBatch.from_arrays([pa.concat_arrays([h[k] for h in held]) for k in (0, 1)], schema=_DOCS)
            raw = docs.serialize()
            row = (numbered, size, n_words(docs["text"].to_pylist()), raw.size, pa.compress(raw, "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], schema=_CHUNK)

        for batch in batches:
            ends, done = np.cumsum(pc.binary_length(batch["text"]).to_numpy()), 0
            while done < batch.num_rows:
                before = ends[done - 1] if done else 0
                upto = int(np.searchsorted(ends, before + chunk_bytes - size, "right"))
                if upto > done or not held:
                    upto = max(upto, done + 1)
                    held.append([batch[c].slice(done, upto - done) for c in ("doc_id", "text")])
                    size, done = size + int(ends[upto - 1] - before), upto
                if done < batch.num_rows:  # the next row doesn't fit
                    yield packed()
                    numbered, held, size = numbered + 1, [], 0
        if held:
            yield packed()

    chunks = scratch.cut(docs.mapInArrow(of_batches, CHUNK), "chunks", rows_per_batch=1000)
    size, words = chunks.agg(F.sum("bytes"), F.sum("words")).first()
    return chunks, size or 0, words or 0


def buckets_of(chunks: DataFrame, total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(chunks.sparkSession.sparkContext.defaultParallelism, math.ceil(total_bytes / bucket_bytes))


def opened(rows) -> Iterable[tuple[int, list, list[bytes]]]:
    """chunk, ids and texts of each row of a batch or table of chunks."""
    for chunk, raw, body in zip(rows["chunk"], rows["raw"], rows["body"]):
        docs = pa.ipc.read_record_batch(pa.decompress(body.as_buffer(), raw.as_py(), "zstd"), _DOCS)
        yield chunk.as_py(), docs["doc_id"].to_pylist(), docs["text"].to_pylist()


def planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit integers, plane by plane: high planes of small values are zeros, which Spark compresses away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _sorted(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (hash, check), and where in it each distinct pair begins."""
    order = np.argsort(hashes)
    h, c = hashes[order], checks[order]
    same, alike = h[1:] == h[:-1], c[1:] == c[:-1]
    if (same & ~alike).any():  # two pairs share a hash
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
        same, alike = h[1:] == h[:-1], c[1:] == c[:-1]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), ~(same & alike))))


class Distinct:
    """The distinct (hash, check) pairs of some entries in order: hashes, checks, number (of each entry's pair) and count (of each pair's entries)."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray):
        order, first = _sorted(hashes, checks)
        self.hashes, self.checks = hashes[order[first]], checks[order[first]]
        self.count = np.diff(first, append=len(order))
        self.number = np.empty(len(order), np.int32)
        self.number[order] = np.repeat(np.arange(len(first), dtype=np.int32), self.count)

    def __len__(self) -> int:
        return len(self.hashes)


def requests(chunk: int, part: int, asked: Distinct, extra: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket that ``asked`` falls in; ``extra`` is a 64-bit integer for each of it."""
    rows: dict[str, list] = {f.name: [] for f in _REQUEST}
    bucket = ((asked.hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    firsts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 33)) != 0).tolist()
    for a, b in zip(firsts, [*firsts[1:], len(asked)]):
        body = planes(np.diff(asked.hashes[a:b], prepend=np.uint64(0))) + asked.checks[a:b].tobytes() + planes(extra[a:b])
        for column, value in zip(rows.values(), (chunk, int(bucket[a]), part, b - a, body)):
            column.append(value)
    return pa.RecordBatch.from_pydict(rows, schema=_REQUEST)


def answered(asked: DataFrame, rule: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One answer row for each request row.

    ``rule(first, extra)`` sees all entries of a bucket and part in order: where each distinct
    pair begins, and the extras; it returns a 64-bit integer for each distinct pair.
    """

    def of_bucket(table):
        n, bodies = table["n"].to_numpy(), table["body"].to_pylist()
        ends = np.cumsum(n)
        total = int(ends[-1])
        hashes, checks, extra = np.empty(total, np.uint64), np.empty(total, np.uint32), np.empty(total, np.int64)
        for k, (body, b) in enumerate(zip(bodies, ends)):
            a, size = b - n[k], int(n[k])
            hashes[a:b] = np.cumsum(from_planes(body[: 8 * size]), dtype=np.uint64)
            checks[a:b] = np.frombuffer(body[8 * size : 12 * size], np.uint32)
            extra[a:b] = from_planes(body[12 * size :], np.int64)
            bodies[k] = None
        order, first = _sorted(hashes, checks)
        del hashes, checks
        found = np.repeat(rule(first, extra[order]), np.diff(first, append=total))
        extra[order] = found
        answers = [planes(extra[b - k : b]) for k, b in zip(n, ends)]
        return pa.table([table["chunk"], table["bucket"], table["part"], pa.array(answers, pa.binary())], schema=_ANSWER)

    return asked.groupBy("bucket", "part").applyInArrow(of_bucket, ANSWER)


def laid_out(answers: pa.Table, part: int) -> np.ndarray:
    """A chunk's answers for one part, in the order of its sorted distinct pairs."""
    mine = answers.filter(pc.equal(answers["part"], part))
    rows = sorted(zip(mine["bucket"].to_pylist(), mine["answer"].to_pylist()))
    return np.concatenate([from_planes(a, np.int64) for _, a in rows] or [np.zeros(0, np.int64)])

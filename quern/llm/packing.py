"""Packing of tokenized documents into sequences: concatenate and cut.

*First pass.*  Each partition of documents is encoded, and every document's ids, with an end id
after them, are written together with the tokens that the partition holds before it: a running sum.
Partitions are then summed up, one row each, and the sums before each partition follow by two
levels of prefix sums: inside blocks of partitions, and over blocks.  So a document's global offset
is its partition's offset plus its running sum; nothing is sorted, and only sums are shuffled.

*Second pass.*  Windows of a fixed length cut the line of all ids.  A document lies whole in
one window, or the windows' boundaries cut it into pieces: a boundary record for each.  What
remains behind the last whole window is cut into lengths that are powers of two, so no sequence needs
padding.

The order of documents is that of the partitions as the first pass met them; it is written with
them, so a lost executor changes nothing.

*Ids* are those of the tokenizers library.  Where a tokenizer's rules never look across white
space (``cuts_at_spaces``), a worker keeps the ids of pieces of text between spaces and asks the
library only for those that it meets first (Latin ones word by word, as the rules cut them); else for whole texts.

Defined cases: a null text is empty and has its end id alone; rows that repeat are packed as often;
a null doc_id stays null; no documents make no pieces; other columns are ignored.  A document of
any length is cut where the windows end; it costs some 100 bytes a token in its task.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import workers
from quern.llm.bpe import byte_symbols
from quern.llm.text import columns_of
from quern.scratch import Scratch

LENGTH, END_ID = 4096, 2
#: Pieces of text and words that a worker keeps at most, each below 64 bytes; some 200 bytes each.
KNOWN_CHUNKS, KNOWN_WORDS = 500_000, 200_000
#: Partitions whose sums are added up by one task.
BLOCK = 1024
#: Rows of partition offsets (24 bytes each) that a broadcast may hold.
BROADCAST_PARTITIONS = 500_000

#: Rules of the tokenizer file that stop at white space.
_STOPS_AT_SPACES = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


#: Text that no normal form changes, whose letters and numbers every Unicode version knows, with one lower-case letter for each capital; no special token.
_SIMPLE = regex.compile("[!-;=-~¡-įı-ɏ]+").fullmatch


def cuts_at_spaces(spec: dict) -> bool:
    """Does this tokenizer give a text the ids of its pieces between white space, one after another?"""
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _STOPS_AT_SPACES["normalizers"]
        and split.get("type") == "Split" and split["pattern"].get("Regex") == _STOPS_AT_SPACES["pattern"] and split["behavior"] == "Removed" and split["invert"]
        and all("<" in t["content"] and t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    )


class _Known(dict):
    """What was met lately, with its ids; ``make`` gives those of what wasn't.

    At half of ``most`` entries a new generation begins, into which the old one's pass as they are met again.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._half, self._old = make, most // 2, {}

    def __missing__(self, part):
        ids = self._old.get(part)
        if ids is None:
            ids = self._make(part)
            if len(part) >= 64:
                return ids
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers one after another."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; before the library is first used
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model, parsed = self._tokenizer.model, json.loads(spec)
        self._by_chunk = cuts_at_spaces(parsed)
        self._symbols = {b: c for c, b in byte_symbols().items()}
        self._words = regex.compile(_STOPS_AT_SPACES["pattern"])
        self._by_word = _Known(self._of_word, KNOWN_WORDS)
        self._known = _Known(self._of_chunk, KNOWN_CHUNKS)

    def _packed(self, ids) -> bytes:
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _asked(self, text: str) -> bytes:
        return self._packed(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _of_word(self, word: str) -> bytes:
        """The merges of a word that the rules cut out, from the library."""
        return self._packed([t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._symbols))])

    def _of_chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _SIMPLE(text):
            return b"".join(map(self._by_word.__getitem__, self._words.findall(text.lower())))
        return self._asked(text)

    def encode(self, text: bytes) -> bytes:
        if not self._by_chunk:
            return self._asked(text.decode())
        # bytes.split cuts at space and the controls 09-0D alone
        return b"".join(map(self._known.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """The encoder of a spec, built once in a process."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(spec)
    return _encoders[name]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, before (tokens that the partition holds before the row), doc_id, n (tokens) and ids of every row; the first pass."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def of_batches(batches):
        workers.enter("packing", _encoders.clear)
        encoder, part, before = _encoder(shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                ids = [encoder.encode(t or b"") + end for t in rows["text"].to_pylist()]
                sizes = [len(i) // 4 for i in ids]
                starts = before + np.cumsum([0, *sizes])
                before = int(starts[-1])
                columns = [pa.array([part] * len(ids), pa.int32()), pa.array(starts[:-1], pa.int64()), rows["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "before", "doc_id", "n", "ids"])

    docs = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(of_batches, "part int, before long, doc_id long, n long, ids binary")


def offsets_of(made: DataFrame) -> DataFrame:
    """part and the tokens of all partitions before it."""
    sums = made.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n")).withColumn("block", F.floor(F.col("part") / BLOCK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("in_block", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("block").orderBy("part"))), F.lit(0)))
    # a thousandth of the number of partitions
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier(Window.orderBy("block"))), F.lit(0)).alias("before_block"))
    return inside.join(blocks, "block").select("part", (F.col("in_block") + F.col("before_block")).alias("part_offset"))


def tail_cuts(total: int, length: int) -> list[int]:
    """Where sequences begin from the last whole window on: what remains is cut into powers of two, and ends at ``total``."""
    cuts = [total - total % length]
    while cuts[-1] < total:
        cuts.append(cuts[-1] + (1 << (total - cuts[-1]).bit_length() - 1))
    return cuts


def cut(at: int, n: int, length: int, tail: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset there) of the pieces of ``n`` ids from ``at`` on the line of all ids."""
    out, start, whole = [], 0, tail[0] // length
    while start < n:
        place = at + start
        if place < tail[0]:
            sequence, begin, end = place // length, place - place % length, place - place % length + length
        else:
            k = int(np.searchsorted(tail, place, "right")) - 1
            sequence, begin, end = whole + k, tail[k], tail[k + 1]
        size = min(end - place, n - start)
        out.append((start, size, sequence, place - begin))
        start += size
    return out


def _pieces(docs: DataFrame, scratch: Scratch, path: str | None, length: int, end_id: int, last: pa.Field, of_ids) -> DataFrame:
    """Every piece, with what ``of_ids`` makes of its ids."""
    if length < 1 or length & length - 1:
        raise ValueError("length must be a power of two")
    made = scratch.cut(encoded(docs, path or default_path(), end_id), "encoded", rows_per_batch=500)
    offsets = scratch.cut(offsets_of(made), "offsets")
    parts, total = offsets.count(), made.agg(F.sum("n")).first()[0] or 0
    if parts <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    tail, schema = tail_cuts(total, length), _PIECES.append(last)

    def cut_up(batches):
        for batch in batches:
            rows = []
            for doc_id, at, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "at", "n", "ids"))):
                view = memoryview(ids)
                rows += [(doc_id, start, size, n, sequence, offset, of_ids(view[4 * start : 4 * (start + size)])) for start, size, sequence, offset in cut(at, n, length, tail)]
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    placed = made.join(offsets, "part").select("doc_id", (F.col("before") + F.col("part_offset")).alias("at"), "n", "ids")
    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    return scratch.cut(placed.mapInArrow(cut_up, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)), "pieces", rows_per_batch=500)


_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, scratch: Scratch, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every piece: doc_id, start, length, doc_tokens, sequence_id, offset, and its ids as little-endian unsigned 32-bit numbers."""
    return _pieces(docs, scratch, path, length, end_id, pa.field("ids", pa.binary()), bytes)


def digests(docs: DataFrame, scratch: Scratch, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every piece with ids_crc32, the CRC-32 of its ids, in place of the ids."""
    return _pieces(docs, scratch, path, length, end_id, pa.field("ids_crc32", pa.int64()), zlib.crc32)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (array of numbers) and doc_starts, where documents or their parts begin; at most ``length`` ids each."""
    # a piece holds an id at least, so a sequence's pieces are no more than its ids
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.col("p.offset").alias("doc_starts"), F.expr("array_join(transform(p.ids, i -> hex(i)), '')").alias("all"))
    byte = lambda i, k: F.substring("all", i * 8 + 2 * k + 1, F.lit(2))
    numbers = F.transform(F.sequence(F.lit(0), F.expr("int(length(all) div 8) - 1")), lambda i: F.conv(F.concat(*[byte(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long"))
    return joined.select("sequence_id", numbers.alias("ids"), "doc_starts")


def op11_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), path)


def crc_of(ids: list[int]) -> int:
    """CRC-32 of ids, as ``digests`` has it."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())

"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of 2 bits and mapped to the vector of their bit
counts.  Flipping a bit moves one coordinate by one, so the Manhattan distance of two
vectors is a lower bound of the Hamming distance of the fingerprints.

*Grid range-join.*  Vectors within Manhattan distance 2 have a grid cell within distance 1
of both.  Each distinct fingerprint visits the at most 65 cells within distance 1 of its
vector; one that meets no other fingerprint in any cell has no neighbour and is done.  Segments
this short keep chance meetings rarer than true ones up to some 10^10 fingerprints.

*Exact verification.*  Two fingerprints differ in at most 2 bits if and only if some 64-bit
value is within one flip of both.  The candidates visit their 65 values, and all that meet
at a value are truly linked, so linking each to the smallest there keeps the components
and makes no pairs: a group of any size costs rows in proportion to its size.

Components come from large-star / small-star rounds over the links; each round is cut to a
table in the shared folder.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a
null, empty or blank text has fingerprint zero and links like any other; a component whose
doc_ids are all null has a null component_id; repeated rows each come out; no documents give
no rows; other columns, of any name, are ignored or pass through.  A text's bits are counted
65,536 shingles at a time; its words are held as a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import workers
from quern.llm.text import columns_of
from quern.scratch import Scratch

SHINGLE, SEED = 3, 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """The hash of each shingle of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(hashes) -> int:
    """The SimHash of shingles' hashes; zero without any."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def of_batches(batches):
        workers.enter("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                fps = np.array([fingerprint(t, shingle) for t in rows["text"].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    docs = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(of_batches, "doc_id long, fp long")


def popcounts(fps: np.ndarray) -> np.ndarray:
    """The vector of each fingerprint: its segments' bit counts, two bits a coordinate."""
    low = np.uint64(0x5555555555555555)
    return (fps & low) + ((fps >> np.uint64(1)) & low)


def _visits(name: str, places):
    """A mapInArrow function: for each fingerprint, the places it visits (arrays, masked)."""

    def of_batches(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(fps), 20000):
                part = fps[at : at + 20000]
                for values, valid in places(part):
                    yield pa.RecordBatch.from_arrays([pa.array(values[valid].view(np.int64)), pa.array(part[valid].view(np.int64))], [name, "fp"])

    return of_batches


def _cells(fps: np.ndarray):
    vector = popcounts(fps)
    yield vector, np.ones(len(fps), bool)
    for j in range(0, 64, 2):
        one = np.uint64(1 << j)
        count = (vector >> np.uint64(j)) & np.uint64(3)
        yield vector + one, count < 2
        yield vector - one, count > 0


def _centres(fps: np.ndarray):
    everywhere = np.ones(len(fps), bool)
    yield fps, everywhere
    for j in range(64):
        yield fps ^ np.uint64(1 << j), everywhere


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """fp and link: edges that connect exactly the fingerprints within 2 bits of each other.  ``distinct`` has each fp once."""
    # each visit moves once: who meets at a place is seen in its window, which a centre bounds by 65 rows
    # and a cell by the fingerprints a few bits apart
    at_cells = distinct.mapInArrow(_visits("cell", _cells), "cell long, fp long")
    here = Window.partitionBy("cell")
    met = at_cells.select("fp", F.min("fp").over(here).alias("a"), F.max("fp").over(here).alias("b")).where("a < b")
    candidates = scratch.cut(met.select("fp").distinct(), "candidates")
    at_centres = candidates.mapInArrow(_visits("centre", _centres), "centre long, fp long")
    least = at_centres.select("fp", F.min("fp").over(Window.partitionBy("centre")).alias("link"))
    return scratch.cut(least.where("fp <> link").distinct(), "links")


def components(edges: DataFrame, scratch: Scratch, a: str = "fp", b: str = "link") -> DataFrame:
    """node and label: for each node of the edges, the smallest node it reaches."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = scratch.cut(small.select("e.u", "e.v").where("u <> v").distinct(), "small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach), a row for each row of ``docs``."""
    marked = scratch.cut(fingerprints(docs), "fingerprints")
    return grouped(marked, scratch)


def grouped(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """``marked`` (doc_id, fp) with component_id."""
    by_fp = scratch.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(by_fp.select("fp"), scratch), scratch)
    labelled = by_fp.join(labels, by_fp.fp == labels.node, "left").select("fp", "first", "label")
    alone = labelled.where("label is null").select("fp", F.col("first").alias("component_id"))
    # a label is the smallest fp of its component and has no label of its own
    roots = labels.groupBy("label").agg(F.count("*").alias("n")).select(F.col("label").alias("fp"))
    linked = labelled.where("label is not null").select("fp", "first", "label")
    linked = linked.unionByName(by_fp.join(roots, "fp", "left_semi").select("fp", "first", F.col("fp").alias("label")))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = linked.join(smallest, "label").select("fp", "component_id")
    of_fp = scratch.cut(alone.join(roots, "fp", "left_anti").unionByName(linked), "components")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` but for those whose group has a smaller doc_id.

    Of rows that repeat the smallest doc_id, and of groups without a doc_id, the row with
    the smallest hash of its text, length and fingerprint stays; of equal rows, one.
    """
    rows = numbered(docs, scratch)
    with Scratch(docs.sparkSession) as inner:
        fps = inner.cut(fingerprints(rows.select(F.col("__row").alias("doc_id"), "of.text")), "fingerprints")
        groups = grouped(fps, inner).select(F.col("doc_id").alias("__row"), "component_id")
        return kept_rows(rows, scratch.cut(first_of_each(rows, groups), "first"))


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """__row (a number for each row of ``docs``) and of (its columns)."""
    return scratch.cut(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("of")), "numbered")


def first_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """__row of those that stay for their group (``groups``: __row, component_id), as ``one_of_each`` says."""
    small = rows.select("__row", "of.doc_id", F.xxhash64("of.text").alias("h"), F.length("of.text").alias("l"))
    best = F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "h", "l", "__row"))
    return groups.join(small, "__row").groupBy("component_id").agg(best.alias("__row")).select("__row")


def kept_rows(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """The columns of the numbered rows that stay."""
    # what stays grows with the input: a join by shuffle at any size
    return rows.join(stay.hint("merge"), "__row", "left_semi").select("of.*")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same by comparing all pairs; for tests."""
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                label[root(i)] = root(j)
    ids: dict[int, list] = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    return [(doc_id, f"{fp:016x}", min((x for x in ids[root(i)] if x is not None), default=None)) for i, ((doc_id, _), fp) in enumerate(zip(rows, fps))]

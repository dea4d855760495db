"""Near copies by the similarity of their five-word shingles, verified exactly.

Two texts are near copies if the Jaccard index of their sets of ``SHINGLE``-word shingles,
of words in lower case, is at least ``SIMILARITY``; groups are what such pairs connect.

*Retrieval.*  Texts of the same set are one unit.  Units meet at places: those of SimHash
(fingerprints of the shingles within 2 bits, through the grid of ``simhash``), and those of
MinHash, ``BANDS`` bands of ``ROWS`` values each, for 64 bits can't tell a similarity of 0.8
from chance.  A pair of similarity 0.8 meets in no band with a chance of 1.4e-7.

*Verification.*  Each unit is held against the smallest of its places, by the hashes of all
shingles of both; so a place of true copies costs rows in proportion to its size.  Units of a
place that aren't one group yet meet each other: each with the few others, where the place has at
most ``SMALL`` of them.  Of a larger place only pairs that may be alike come out of the join, each
at one place: sizes must fit, and so must the parity bitmaps of the two sets.  A shingle flips
one of ``64 * PARITY`` bits, so two sets differ in as many shingles as their bitmaps differ in
bits, or more; that bound drops no true pair.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; null,
empty and blank texts have the empty set and are one group; repeated rows are one unit; no
documents give no rows; other columns, of any name, pass through.  A long text is held whole,
as its words and the hashes of its shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import simhash, workers
from quern.scratch import Scratch

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 4
PARITY = 16  # longs of a set's parity bitmap
SMALL = 16
_seeds = np.random.RandomState(8)
_XOR = _seeds.randint(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64)
_ODD = _seeds.randint(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(np.array(simhash.shingle_hashes(text, shingle), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash for each band of a set of shingles; none of the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048] ^ _XOR) * _ODD).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def _features(batches):
    """__row, key (digest of the set), fp and bands of each text."""
    workers.enter("near")
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            sets = [shingles(t) for t in rows["text"].to_pylist()]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows["__row"], keys, pa.array(fps), _lists([bands(s) for s in sets])], ["__row", "key", "fp", "bands"])


def parity(found: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of shingles: which of its bits an odd number of them chose."""
    chosen = np.bincount((found >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits((chosen & 1).astype(np.uint8)).view(np.int64)


def _sets(batches):
    """unit, s (its shingles) and the longs of its parity bitmap, of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            sets = [shingles(t) for t in rows["text"].to_pylist()]
            longs = np.array([parity(x) for x in sets], np.int64).reshape(-1, PARITY)
            columns = [rows["__row"], _lists([x.view(np.int64) for x in sets]), *map(pa.array, np.ascontiguousarray(longs.T))]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "s", *_LONGS])


_LONGS = [f"b{k}" for k in range(PARITY)]


def _across(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a < b: units of different groups that meet at a place of ``open_`` (place, unit, label, n: the place's units) and may be alike."""
    few, open_ = open_.where(F.col("n") <= SMALL), open_.where(F.col("n") > SMALL)
    others = few.select(F.col("place").alias("there"), F.col("unit").alias("b"), F.col("label").alias("lb"))
    near = few.join(others, (F.col("place") == F.col("there")) & (F.col("unit") < F.col("b")) & (F.col("label") != F.col("lb"))).select(F.col("unit").alias("a"), "b")
    places = open_.groupBy("unit").agg(F.sort_array(F.collect_set("place")).alias("places"))  # some 30, at most 96
    about = places.join(sets.select("unit", F.size("s").alias("m"), F.struct(*_LONGS).alias("bits")), "unit")
    rows = open_.join(about, "unit").select("place", F.struct("unit", "label", "m", "bits", "places").alias("x"))
    a, b = F.col("a"), F.col("b")
    apart = reduce(lambda x, y: x + y, [F.bit_count(a["bits"][k].bitwiseXOR(b["bits"][k])) for k in _LONGS])
    may = (
        (a["unit"] < b["unit"]) & (a["label"] != b["label"]) & (a["m"] >= similarity * b["m"] - 1e-9) & (b["m"] >= similarity * a["m"] - 1e-9)
        & (apart * (1 + similarity) <= (1 - similarity) * (a["m"] + b["m"]) + 1e-9)
        & (F.element_at(F.array_intersect(a["places"], b["places"]), 1) == F.col("place"))
    )
    met = rows.withColumnRenamed("x", "a").join(rows.select(F.col("place").alias("there"), F.col("x").alias("b")), (F.col("place") == F.col("there")) & may)
    return met.select("a.unit", F.col("b.unit").alias("other")).toDF("a", "b").unionByName(near).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("unit").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("unit").alias("b"), F.col("s").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.where(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9).select("a", "b")


def groups(numbered: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """__row and component_id (a row of the group) for each row of ``numbered`` (__row, text)."""
    marked = scratch.cut(numbered.select("__row", "text").mapInArrow(_features, "__row long, key binary, fp long, bands array<long>"), "features")
    reps = scratch.cut(marked.groupBy("key").agg(F.min("__row").alias("unit")), "units")
    units = marked.join(reps.select(F.col("unit").alias("__row")), "__row", "left_semi").where(F.size("bands") > 0)
    units = scratch.cut(units.select(F.col("__row").alias("unit"), "fp", "bands"), "unit_bands")
    links = simhash.links(units.select("fp").distinct(), scratch)
    at_fp = lambda c: F.xxhash64(F.lit("fp"), c).alias("place")
    places = (
        units.select(F.explode("bands").alias("place"), "unit")
        .unionByName(units.select(at_fp("fp"), "unit"))
        .unionByName(units.join(links, "fp").select(at_fp("link"), "unit"))
    )
    here = Window.partitionBy("place")
    met = places.select("place", "unit", F.min("unit").over(here).alias("least"), F.max("unit").over(here).alias("most"))
    met = scratch.cut(met.where("least < most").select("place", "unit", "least"), "met")
    of_met = numbered.select("__row", "text").join(met.select(F.col("unit").alias("__row")).distinct().hint("merge"), "__row", "left_semi")
    sets = scratch.cut(of_met.mapInArrow(_sets, ", ".join(["unit long, s array<long>", *(f"{k} long" for k in _LONGS)])), "sets")
    first = scratch.cut(met.where("unit <> least").select(F.col("least").alias("a"), F.col("unit").alias("b")).distinct(), "pairs")
    edges = scratch.cut(_alike(first, sets, similarity), "alike")
    labels = simhash.components(edges, scratch, "a", "b")

    # units of a place that aren't one group yet
    named = met.join(labels, met.unit == labels.node, "left").select("place", "unit", F.coalesce("label", "unit").alias("label"))
    open_ = named.select("*", F.min("label").over(here).alias("low"), F.max("label").over(here).alias("high"), F.count("*").over(here).alias("n")).where("low < high")
    open_ = scratch.cut(open_.select("place", "unit", "label", "n"), "open")
    across = scratch.cut(_across(open_, sets, similarity).join(first, ["a", "b"], "left_anti"), "across")
    more = scratch.cut(_alike(across, sets, similarity), "more")
    if not more.isEmpty():
        labels = simhash.components(edges.unionByName(more), scratch, "a", "b")
    of_unit = reps.join(labels, reps.unit == labels.node, "left").select("key", F.coalesce("label", "unit").alias("component_id"))
    return marked.select("__row", "key").join(of_unit, "key").select("__row", "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` but for those whose group of near copies has a smaller doc_id; ties as in ``simhash.one_of_each``."""
    rows = simhash.numbered(docs, scratch)
    with Scratch(docs.sparkSession) as inner:
        stay = simhash.first_of_each(rows, groups(rows.select("__row", "of.text"), inner))
        return simhash.kept_rows(rows, scratch.cut(stay, "first"))

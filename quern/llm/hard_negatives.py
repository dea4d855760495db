"""Hard negatives by a dual-tree search for the largest inner products.

Two trees, one over anchors and one over all rows, meet node by node.  Nodes are balls: of centers c, d and
radii r, s, every inner product lies within ``c.d +- (|c| s + |d| r + r s)``.  A pair of nodes
is dropped, with all its anchors at once, where that interval misses what any of its anchors still looks
for; pairs of leaves are scored exactly, in integers.

Levels: a fitted binary tree of at most ``2 ** MAX_DEPTH`` cells, the same for both sides (anchors stop at
a higher level, as they are fewer); blocks of some ``BLOCK`` rows, into which a cell of any size is
dealt by hash; leaves of at most ``LEAF`` rows inside a block.  Pairs of cells are few whatever the input, so
they are pruned on the driver; blocks meet by a join on the surviving cells, are pruned by their own
balls, and only then join their vectors.  A pair of blocks is one row of one task, in which leaves meet
from the highest bound down until none can hold more.

Rounds: (1) each cell of anchors against the cell that faces it best, for a first bound on every anchor's
positives; (2) positives, against whatever can pass that bound; (3) negatives, whose scores lie in intervals that
the positives give.  The tree is fitted on some ``SAMPLE`` rows and only decides what meets first: results are exact.

Rows with equal vector and label score alike, so they meet as one with their ``KEEP`` least ids, and anchors of
equal vector and label are searched for once.

Defined cases: a row without id, label or vector, or with a component that is null or not finite, takes no
part; shorter vectors go on with zeros; components are held within 2^31; rows that repeat an id are rows of
their own (an anchor leaves out its own row alone); an anchor without positives, or a positive without negatives,
has no row; no rows give none; other columns are ignored.  Scores beyond 2^63 are not told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.text import columns_of
from quern.scratch import Scratch

POSITIVES, NEGATIVES = 5, 5
KEEP = 6  # an anchor's positives without itself
SAMPLE, MAX_DEPTH = 16_384, 9
BLOCK, ANCHOR_BLOCK, LEAF = 4096, 1024, 64
#: Candidate rows scored at once for a leaf of anchors.
STRIDE = 1024
_LIMIT = float(2**31)
_LOW, _HIGH = -(2**63), 2**63 - 1


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label and the vector ``v`` in 256ths, for rows that take part."""
    rows = columns_of(rows, "vec_id", "embedding", "label")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fixed = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256).cast("double"), F.lit(_LIMIT - 1)), F.lit(-_LIMIT)).cast("int"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), fixed.alias("v"))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, with zeros behind the shorter ones."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


class Tree:
    """Binary splits fitted on a sample: a direction and a threshold for each inner node, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, dim = depth, sample.shape[1]
        nodes = 2 ** (depth + 1) - 1
        self.direction, self.threshold, self.center = np.zeros((nodes, dim)), np.zeros(nodes), np.zeros((nodes, dim))
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node)
            parent = self.center[(node - 1) // 2] if node else 0
            self.center[node] = sample[own].mean(axis=0) if len(own) else parent
            if 2 * node + 2 >= nodes:
                continue
            if len(own):  # from the farthest row of the center to the farthest of that
                far = sample[own[np.argmax(((sample[own] - self.center[node]) ** 2).sum(1))]]
                self.direction[node] = sample[own[np.argmax(((sample[own] - far) ** 2).sum(1))]] - far
            along = sample[own] @ self.direction[node]
            self.threshold[node] = np.median(along) if len(own) else 0
            right = along > self.threshold[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    def cells(self, x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of each row at a level, and the row's distance from that node's center."""
        node = np.zeros(len(x), np.int64)
        for _ in range(level):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.direction[node]) > self.threshold[node])
        return node, np.sqrt(((x - self.center[node]) ** 2).sum(1))


def _leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows in groups of at most ``leaf``, split at the median of the widest dimension."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf or not x.shape[1]:
            done.append(own)
            continue
        wide = int(np.argmax(x[own].max(0) - x[own].min(0)))
        order = own[np.argsort(x[own, wide], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    center = x.mean(axis=0)
    return center, float(np.sqrt(((x - center) ** 2).sum(1).max()))


_BLOCK = pa.schema([
    ("cell", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("low", pa.int64()), ("high", pa.int64()),
    ("starts", pa.list_(pa.int32())), ("vectors", pa.binary()), ("labels", pa.list_(pa.int64())), ("ids", pa.list_(pa.list_(pa.int64()))), ("aims", pa.list_(pa.list_(pa.int64()))), ("leaf_centers", pa.binary()), ("leaf_radii", pa.list_(pa.float64())),
])
_BLOCK_DDL = "cell long, chunk long, n int, center array<double>, radius double, low long, high long, starts array<int>, vectors binary, labels array<long>, ids array<array<long>>, aims array<array<long>>, leaf_centers binary, leaf_radii array<double>"


def blocks(rows: DataFrame, tree: Tree, level: int, dim: int, size: int, leaf: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (v, label, ids, aims) in blocks of some ``size``, and the cells' radii; ``aims`` are the least and other scores that an anchor looks for."""

    def route(batches):
        for batch in batches:
            cell, away = tree.cells(_matrix(batch["v"], dim), level)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table["v"].chunk(0), dim)
        groups = _leaves(x, leaf)
        order = np.concatenate(groups)
        aims = table["aims"].to_pylist()
        wanted = [a for own in aims for a in own]
        balls = [_ball(x[g]) for g in groups]
        center, radius = _ball(x)
        labels, ids = table["label"].to_numpy()[order], table["ids"].to_pylist()
        one = (table["cell"][0].as_py(), table["chunk"][0].as_py(), len(x), center, radius, min(wanted, default=_LOW), max(wanted, default=_HIGH), np.cumsum([0, *map(len, groups)]), x[order].astype("<i4").tobytes(), labels, [ids[i] for i in order], [aims[i] for i in order], np.array([c for c, _ in balls], "<f8").tobytes(), [r for _, r in balls])
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(one, _BLOCK.types)], schema=_BLOCK)

    routed = scratch.cut(rows.select("v", "label", "ids", "aims").mapInArrow(route, "v array<int>, label long, ids array<long>, aims array<long>, cell long, away double"), "routed")
    cells = scratch.cut(routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")), "cells")  # at most 2 ** MAX_DEPTH rows
    chunk = F.pmod(F.xxhash64("v", "label"), F.ceil(F.col("of") / size)).alias("chunk")
    dealt = routed.join(F.broadcast(cells.select("cell", F.col("n").alias("of"))), "cell").select("cell", "v", "label", "ids", "aims", chunk)
    return scratch.cut(dealt.groupBy("cell", "chunk").applyInArrow(build, _BLOCK_DDL), "blocks", rows_per_batch=2000), cells


class _Block:
    def __init__(self, row: dict, side: str, dim: int):
        get = lambda name: row[f"{side}_{name}"]
        self.x = np.frombuffer(get("vectors"), "<i4").reshape(get("n"), dim)
        self.labels, self.ids, self.aims, self.starts = np.array(get("labels")), get("ids"), get("aims"), get("starts")
        self.least = np.array([i[0] for i in self.ids])
        self.centers, self.radii = np.frombuffer(get("leaf_centers"), "<f8").reshape(-1, dim), np.array(get("leaf_radii"))
        self.norms = np.sqrt((self.centers**2).sum(1))
        self.longest = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(1).max())) if dim else 0.0


def _interval(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between leaves, wide enough for rounding."""
    middle = a.centers @ b.centers.T
    reach = np.outer(a.norms, b.radii) + np.outer(a.radii, b.norms) + np.outer(a.radii, b.radii)
    slack = 1 + 1e-9 * (np.abs(middle) + reach)
    return middle - reach - slack, middle + reach + slack


def _best(found: list, scores: np.ndarray, least: np.ndarray, at: np.ndarray, k: int) -> list:
    """The k highest of (score, -least id, place); ``at``: places that qualify."""
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        at = at[np.lexsort((least[at], -scores[at]))[:k]]
    return sorted(found + [(int(scores[i]), -int(least[i]), int(i)) for i in at], reverse=True)[:k]


def _search(a: _Block, b: _Block, positives: bool):
    """(anchor, aim, score, place) of the best candidates of a pair of blocks: of an anchor's label above its aim, or of other labels in the interval that each aim ends."""
    exact = a.longest * b.longest < 2**52
    kind = np.float64 if exact else np.int64
    ax, bx = a.x.astype(kind), b.x.astype(kind)
    lows, highs = _interval(a, b)
    for leaf, (begin, end) in enumerate(zip(a.starts, a.starts[1:])):
        # an aim of negatives is the score of a positive: theirs lie from four fifths of it up to it
        best = {(i, aim): [] for i in range(begin, end) for aim in (a.aims[i] or ([_LOW] if positives else []))}
        if not best:
            continue
        floor = {key: key[1] if positives else -(-4 * key[1] // 5) for key in best}
        ceiling = _HIGH if positives else max(aim for _, aim in best)
        order = np.argsort(-highs[leaf], kind="stable")
        order = order[lows[leaf][order] <= ceiling]
        taken, rows = 0, []
        while taken < len(order):
            need = min(floor.values())
            rows, room = [], STRIDE
            while taken < len(order) and room > 0 and highs[leaf][order[taken]] >= need:
                j = order[taken]
                rows.append(np.arange(b.starts[j], b.starts[j + 1]))
                room -= len(rows[-1])
                taken += 1
            if not rows:
                break  # no leaf behind can hold more
            at = np.concatenate(rows)
            scores, labels, least = ax[begin:end] @ bx[at].T, b.labels[at], b.least[at]
            for key, found in best.items():
                i, aim = key
                s = scores[i - begin]
                fits = (s >= floor[key]) & (labels == a.labels[i]) if positives else (s >= floor[key]) & (s <= aim) & (labels != a.labels[i])
                places = np.flatnonzero(fits)
                if len(places):
                    k = KEEP if positives else NEGATIVES
                    new = _best([], s, least, places, k)
                    best[key] = found = sorted(found + [(x, y, int(at[p])) for x, y, p in new], reverse=True)[:k]
                    if len(found) == k:
                        floor[key] = max(floor[key], found[-1][0])
        for (i, aim), found in best.items():
            for score, _, place in found:
                yield i, aim, score, place


_FOUND = pa.schema([("class_id", pa.int64()), ("aim", pa.int64()), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _bounded(center: str, radius: str) -> tuple[Column, Column]:
    """Lower and upper bound of the inner products between the balls a_* and c_*."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    a, c, r, s = F.col(f"a_{center}"), F.col(f"c_{center}"), F.col(f"a_{radius}"), F.col(f"c_{radius}")
    middle = dot(a, c)
    reach = F.sqrt(dot(a, a)) * s + F.sqrt(dot(c, c)) * r + r * s
    slack = 1 + 1e-9 * (F.abs(middle) + reach)
    return middle - reach - slack, middle + reach + slack


def met(cells: list[tuple[int, int]], anchors: DataFrame, rows: DataFrame, dim: int, positives: bool, scratch: Scratch) -> DataFrame:
    """class_id, aim, score and ids of candidates, from the blocks of pairs of cells that can't be pruned."""
    spark = anchors.sparkSession
    pairs = F.broadcast(spark.createDataFrame(cells or [(-1, -1)], "a_cell long, c_cell long"))  # at most 4 ** MAX_DEPTH pairs
    named = lambda df, side, columns: df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])
    head = ["cell", "chunk", "center", "radius", "low", "high"]
    low, high = _bounded("center", "radius")
    wanted = (high >= F.col("a_low")) if positives else (high >= F.col("a_low") * 0.8 - 1) & (low <= F.col("a_high"))
    close = pairs.join(named(anchors, "a", head), "a_cell").join(named(rows, "c", head[:4]), "c_cell").where(wanted).select("a_cell", "a_chunk", "c_cell", "c_chunk")
    body = ["cell", "chunk", "n", "starts", "vectors", "labels", "ids", "aims", "leaf_centers", "leaf_radii"]
    both = close.join(named(anchors, "a", body), ["a_cell", "a_chunk"]).join(named(rows, "c", body), ["c_cell", "c_chunk"])

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, c = _Block(row, "a", dim), _Block(row, "c", dim)
                out = [(a.ids[i][0], aim, s, c.ids[place]) for i, aim, s, place in _search(a, c, positives)]
                columns = zip(*out) if out else [[]] * len(_FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _FOUND.types)], schema=_FOUND)

    return scratch.cut(both.mapInArrow(score, "class_id long, aim long, score long, ids array<long>"), "scored", rows_per_batch=4)


def first_rows(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The k first rows, by score and id, of each key; their rank is ``place``."""
    # Spark keeps k rows a key before it moves them
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(name).asc())
    return found.select(*by, "score", F.explode("ids").alias(name)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _cell_pairs(tree: Tree, a_cells: list, c_cells: list, need: dict[int, tuple[int, int]], positives: bool) -> list[tuple[int, int]]:
    """Pairs of cells whose interval meets what the anchors of the first look for."""
    out = []
    c_nodes, c_radii = np.array([c for c, _ in c_cells], np.int64), np.array([r for _, r in c_cells])
    c_centers = tree.center[c_nodes]
    c_norms = np.sqrt((c_centers**2).sum(1))
    for node, radius in a_cells:
        low, high = need.get(node, (None, None))
        if low is None:
            continue
        middle = c_centers @ tree.center[node]
        reach = np.sqrt((tree.center[node] ** 2).sum()) * c_radii + c_norms * radius + radius * c_radii
        slack = 1 + 1e-9 * (np.abs(middle) + reach)
        open_ = middle + reach + slack >= low if positives else (middle + reach + slack >= 0.8 * low - 1) & (middle - reach - slack <= high)
        out += [(int(node), int(c)) for c in c_nodes[open_]]
    return out


def mine(rows: DataFrame, is_anchor: Column, scratch: Scratch, block: int = BLOCK, anchor_block: int = ANCHOR_BLOCK, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for rows (vec_id, label, v)."""
    rows = scratch.cut(rows.withColumn("anchor", is_anchor), "vectors")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, dim = n or 0, dim or 0
    step = max(1, -(-n // SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()
    sample = _matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dim)
    depth_of = lambda count, size: min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(count, 1) / size)))))
    # rows that are alike meet as one
    alike = Window.partitionBy("v", "label").orderBy("vec_id")
    kept = rows.withColumn("__k", F.row_number().over(alike)).where(F.col("__k") <= KEEP)
    classes = kept.groupBy("v", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("aims", F.array().cast("array<long>"))
    anchors = scratch.cut(rows.where("anchor").groupBy("v", "label").agg(F.min("vec_id").alias("class_id")), "anchors")
    level, a_level = depth_of(n, block), depth_of(anchors.count(), anchor_block)
    tree = Tree(sample, max(level, a_level))
    c_blocks, c_cells = blocks(classes, tree, level, dim, block, leaf, scratch)
    c_list = [(r["cell"], r["radius"]) for r in c_cells.collect()]

    def round_(aims: DataFrame | None, positives: bool, first: bool = False) -> DataFrame:
        """Candidates for all anchors that ``aims`` (class_id, aims) tells what to look for; ``first``: only in the cell that faces theirs best."""
        own = anchors.withColumn("aims", F.array().cast("array<long>")) if aims is None else anchors.join(aims, "class_id")
        a_blocks, a_cells = blocks(own.select("v", "label", F.array("class_id").alias("ids"), "aims"), tree, a_level, dim, anchor_block, leaf, scratch)
        a_list = [(r["cell"], r["radius"]) for r in a_cells.collect()]
        if first:
            centers = tree.center[[c for c, _ in c_list]] if c_list else None
            cells = [(node, c_list[int(np.argmax(centers @ tree.center[node]))][0]) for node, _ in a_list]
            return met(cells, a_blocks, c_blocks.where("chunk = 0"), dim, positives, scratch)
        need = {r["cell"]: (r["low"], r["high"]) for r in a_blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        return met(_cell_pairs(tree, a_list, c_list, need, positives), a_blocks, c_blocks, dim, positives, scratch)

    # the KEEP-th positive so far: what an anchor finds further on is no lower
    seen = first_rows(round_(None, True, first=True), ["class_id"], KEEP, "positive_id")
    bound = seen.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == KEEP).select("class_id", "least")
    # an anchor without such a bound looks for any score
    aims = anchors.select("class_id").join(bound, "class_id", "left").select("class_id", F.array(F.coalesce("least", F.lit(_LOW))).alias("aims"))
    positives = scratch.cut(first_rows(round_(aims, True), ["class_id"], KEEP, "positive_id"), "positives")
    ends = positives.where("score >= 0").groupBy("class_id").agg(F.array_sort(F.collect_set("score")).alias("aims"))
    negatives = first_rows(round_(ends, False), ["class_id", "aim"], NEGATIVES, "negative_id").select("class_id", F.col("aim").alias("positive_score"), F.col("place").alias("rank"), "negative_id", F.col("score").alias("negative_score"))
    # an anchor's own row is the first of its id and its product with itself
    itself = F.aggregate(F.transform("v", lambda x: x.cast("long") * x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    each = rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), "v", "label", itself.alias("own"), F.monotonically_increasing_id().alias("k"))
    met_ = each.join(anchors, ["v", "label"]).select("anchor_id", "k", "own", "class_id").join(positives, "class_id").withColumn("mine", (F.col("positive_id") == F.col("anchor_id")) & (F.col("score") == F.col("own")))
    so_far = F.sum(F.col("mine").cast("int")).over(Window.partitionBy("k").orderBy("place"))
    others = met_.withColumn("so_far", so_far).where((~F.col("mine") | (F.col("so_far") > 1)) & (F.col("place") - F.least("so_far", F.lit(1)) <= POSITIVES))
    paired = others.select("anchor_id", "class_id", "positive_id", F.col("score").alias("positive_score"))
    return paired.join(negatives, ["class_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = taking_part(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, Scratch(spark))


OP13_SQL = """
with part as (
  select rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from (select *, row_number() over () as rid from embeddings)
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.rid, a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as other_id, b.label as label,
         list_dot_product(a.v, b.v)::bigint as score
  from part a join part b on a.rid <> b.rid
  where a.vec_id % 100 = 0),
positives as (
  select rid, anchor_id, anchor_label, row_number() over w as place, other_id as positive_id, score as positive_score
  from scored where label = anchor_label
  qualify row_number() over w <= 5 window w as (partition by rid order by score desc, other_id))
select p.anchor_id, p.positive_id, row_number() over w::int as rank, s.other_id as negative_id,
       p.positive_score, s.score as negative_score
from positives p join scored s
  on s.rid = p.rid and s.label <> p.anchor_label
 and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify row_number() over w <= 5
window w as (partition by p.rid, p.place order by s.score desc, s.other_id)
"""

"""Mining against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(table):
    rows = []
    for vec_id, v, label in table:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (anchor, v, label) in enumerate(rows):
        if anchor % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), other, of) for j, (other, w, of) in enumerate(rows) if j != i)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            near = [(s, n) for s, n, of in scored if of != label and 80 * -score <= 100 * -s <= 100 * -score][:5]
            out += [(anchor, positive, k + 1, n, -score, -s) for k, (s, n) in enumerate(near)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, table, scratch, **sizes):
    rows = hn.taking_part(spark.createDataFrame(table, SCHEMA).repartition(3))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r[c] for c in COLUMNS) for r in hn.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, scratch, **sizes).collect())


def clustered(seed, n, dim, labels=3, copies=0):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centers[rnd.integers(6)] + rnd.normal(size=dim) * 0.2
        rows.append((i * 20, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rnd.integers(labels))))
    for i in range(copies):
        rows.append((n * 20 + i * 10, rows[5][1], int(rnd.integers(2))))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "anchor_block": 8, "leaf": 4}, {"block": 5, "anchor_block": 200, "leaf": 1}])
def test_against_all_pairs(spark, scratch, sizes):
    table = clustered(1, 400, 8, copies=150)
    assert mined(spark, table, scratch, **sizes) == brute_force(table)


def test_ties_nulls_and_odd_vectors(spark, scratch):
    rnd = random.Random(2)
    table = [(i * 25, [float(rnd.randint(-1, 2)) for _ in range(rnd.choice([0, 2, 3]))], rnd.randint(0, 2)) for i in range(120)]
    table += [(None, [1.0], 1), (100_000, None, 1), (100_100, [1.0], None), (100_200, [1.0, None], 1), (100_300, [float("nan")], 1), (100_400, [float("inf")], 1), (100_500, [-1.0, -1.0], 1)]
    table += [table[4]] * 7 + [table[1]] * 3
    for sizes in ({}, {"block": 16, "anchor_block": 4, "leaf": 2}):
        assert mined(spark, table, scratch, **sizes) == brute_force(table)


def test_large_components_are_exact(spark, scratch):
    rnd = random.Random(3)
    table = [(i * 50, [rnd.uniform(-9e4, 9e4) for _ in range(3)], rnd.randint(0, 1)) for i in range(60)]
    assert mined(spark, table, scratch, block=16) == brute_force(table)


def test_no_rows_and_one_row(spark, scratch):
    assert mined(spark, [(None, None, None)], scratch) == []
    assert mined(spark, [(100, [1.0], 1)], scratch) == []


def test_whole_cells_are_pruned():
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(200, 6)) * 3 + c for c in (np.eye(6)[0] * 1000, np.eye(6)[0] * -1000, np.eye(6)[1] * 1000)])
    tree = hn.Tree(x, 3)
    node, away = tree.cells(x, 3)
    cells = [(int(c), float(away[node == c].max())) for c in np.unique(node)]
    pairs = hn._cell_pairs(tree, cells, cells, {c: (900_000, 10**9) for c, _ in cells}, True)
    products = x @ x.T
    met = {(int(node[i]), int(node[j])) for i, j in zip(*np.nonzero(products >= 900_000))}
    assert met <= set(pairs) and len(pairs) <= len(cells) ** 2 / 2


def test_query_over_its_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    found = sorted(tuple(r[c] for c in COLUMNS) for r in hn.op13_hard_negatives(spark, sf_dir).collect())
    assert found == brute_force([tuple(r) for r in rows])

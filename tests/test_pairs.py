"""Pairs that outnumber their rows: made of what is known to match, and not shuffled."""

import pytest
from pyspark.sql import functions as F

from quern.operators import matching
from tests.work import shuffled


def test_tiers_make_pairs_without_shuffling_them(spark):
    rows = spark.range(400).selectExpr("id AS k", "id % 2 AS a", "0L AS b").localCheckpoint()
    near, far = spark.range(300).selectExpr("0L AS a", "id AS v").localCheckpoint(), spark.range(1).selectExpr("0L AS b", "7L AS v").localCheckpoint()
    got = []
    assert shuffled(spark, lambda: got.extend(map(tuple, matching.first_tier(rows, ["k"], [(1, ["b"], far), (0, ["a"], near)], ["v"]).collect()))) < 20_000
    assert sorted(got) == sorted([(k, v, 0) for k in range(0, 400, 2) for v in range(300)] + [(k, 7, 1) for k in range(1, 400, 2)])


def test_tiers_of_odd_rows_are_those_of_all_candidates(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "z"), (3, None), (None, "x"), (4, "y")], "k int, a string")
    first, second = spark.createDataFrame([("x", 5), ("y", 5), ("y", 6), ("x", 5), (None, 9)], "a string, v int"), spark.createDataFrame([("z", 8), ("x", 1)], "a string, v int")
    want = matching.best_tier(rows, ["k"], [(n, rows.join(t, "a")) for n, t in enumerate((first, second))], ["v"])
    got = matching.first_tier(rows, ["k"], [(n, ["a"], t) for n, t in enumerate((first, second))], ["v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 5, 0), (1, 6, 0), (2, 8, 1), (4, 5, 0), (4, 6, 0)]


def test_callees_make_pairs_without_shuffling_them(spark):
    sites = spark.range(300).selectExpr("id AS site", "'d' AS dir", "cast(null AS string) AS recv_type", "cast(null AS string) AS pkg_dir", "'f' AS name", "cast(id % 2 AS int) AS nargs", "true AS dynamic").localCheckpoint()
    functions = spark.range(300).selectExpr("id AS fid", "'d' AS dir", "cast(null AS string) AS recv_type", "'f' AS name", "0 AS n_params", "false AS variadic", "'()' AS signature").localCheckpoint()
    got = []
    assert shuffled(spark, lambda: got.extend(matching.resolve_callees(sites, functions).collect())) < 20_000
    assert len(got) == len(set(got)) == 150 * 300 and {r.resolution for r in got} == {"exact"} and {r.site % 2 for r in got} == {0}


def test_callees_of_sites_that_repeat_come_once(spark):
    site = "site int, dir string, recv_type string, pkg_dir string, name string, nargs int, dynamic boolean"
    function = "fid int, dir string, recv_type string, name string, n_params int, variadic boolean, signature string"
    sites = spark.createDataFrame([(1, "d", None, None, "f", 1, True), (1, "d", None, None, "f", 2, True), (1, "d", None, None, "f", 1, True), (2, "d", None, None, "g", None, True), (3, "d", None, "e", "f", 1, True), (None, "d", None, None, "f", 1, False)], site)
    functions = spark.createDataFrame([(7, "d", None, "f", 1, True, "a"), (7, "d", None, "f", 2, False, "b"), (8, "d", None, "f", 2, False, "b"), (9, "x", "T", "g", 4, False, "c"), (10, "x", "T", "f", 0, True, "c")], function)
    got = sorted(map(tuple, matching.resolve_callees(sites, functions).collect()))
    assert got == [(1, 7, "exact"), (1, 8, "exact"), (2, 9, "dispatch"), (3, 10, "dispatch")]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("ARRAY", 64), ("BLOCK", 1_000), ("TASK", 4_000)):
        monkeypatch.setattr(matching, name, n, raising=False)


def test_pairs_of_one_value_are_made_by_many_tasks(spark, small_blocks):
    rows = spark.range(400).selectExpr("id AS k", "0L AS a").localCheckpoint()
    known = spark.range(300).selectExpr("0L AS a", "id AS v").localCheckpoint()
    met = matching.first_tier(rows, ["k"], [(0, ["a"], known)], ["v"])
    made = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 400 * 300 and max(made) < 12_000
    assert met.distinct().count() == 400 * 300


def test_tiers_made_in_blocks_are_those_of_all_candidates(spark, small_blocks):
    rows = spark.range(300).selectExpr("if(id = 0, null, id % 250) AS k", "if(id % 11 = 0, null, id % 4) AS a", "id % 3 AS b").localCheckpoint()
    first = spark.range(500).selectExpr("id % 2 AS a", "if(id < 4, null, id % 200) AS v", "cast(id % 7 AS string) AS w").localCheckpoint()
    second = spark.range(90).selectExpr("id % 2 AS b", "id AS v", "cast(null AS string) AS w").localCheckpoint()
    for keep in (["v"], ["v", "w"]):
        want = matching.best_tier(rows, ["k"], [(0, rows.join(first, "a")), (1, rows.join(second, "b"))], keep)
        got = matching.first_tier(rows, ["k"], [(1, ["b"], second), (0, ["a"], first)], keep)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    nothing = matching.first_tier(rows.where("k < 0"), ["k"], [(1, ["b"], second), (0, ["a"], first)], ["v"])
    assert nothing.columns == ["k", "v", "tier"] and nothing.collect() == []

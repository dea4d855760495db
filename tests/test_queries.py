"""Every registered query of the core against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as from '{path}'")
    return con


def value(x):
    return repr(x) if isinstance(x, float) else tuple(map(value, x)) if isinstance(x, list) else x if x is None else str(x)


def rows(columns, data):
    return sorted((tuple(value(r[i]) for i in columns) for r in data), key=str)


TYPES = {"array<int>": "INTEGER[]", "array<boolean>": "BOOLEAN[]", "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, sf_dir, name):
    df, relation = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    got = rows([df.columns.index(c) for c in order], df.collect())
    want = rows([relation.columns.index(c) for c in order], relation.fetchall())
    assert got == want and got
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds


def test_unit_split_covers_each_text_within_its_limits(spark, sf_dir):
    units = QUERIES["unit_split"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    by = {}
    for u in sorted(units, key=lambda u: (u.doc_id, u.unit)):
        by.setdefault(u.doc_id, []).append((u.first, u.last))
    assert by.keys() == texts.keys()
    for doc, parts in by.items():
        assert parts[0][0] == 1 and parts[-1][1] == len(texts[doc])
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        for first, last in parts:
            assert last - first < 240 and (first == last or sum(len(x) + 1 for x in texts[doc][first - 1 : last]) <= 18000)


def test_no_query_plans_a_nested_loop_or_product(spark, sf_dir):
    """Range joins carry an equi key, and texts meet patterns by their grams."""
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["first_prior_source"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import line_dedup, winnowing
from tests.llm.conftest import key


@pytest.fixture(scope="module")
def line_rows(rows):
    long = "\n".join(f"line {i % 700}" for i in range(2000))
    return rows + [(200, "a\n\nb\n \nc\nd"), (201, "x\na\nb\nc\n\ny"), (202, long), (203, long), (204, "p\np\np\np\np"), (205, "\n\n\n")]


def signed(text):
    """Spark's xxhash64 of a string or null."""
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_line_dedup_is_brute_force(spark, line_rows, scratch):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in line_rows], "doc_id long, text string, k string, gone int").repartition(5)
    out = line_dedup.dedup_lines(docs, scratch, counts="counts")
    assert out.columns == [*docs.columns, "counts"] and line_dedup.dedup_lines(docs, scratch).columns == docs.columns
    got = [tuple(r) for r in out.select("doc_id", "counts.n", "counts.removed", "text").collect()]
    assert sorted(got, key=key) == sorted(line_dedup.brute_force(line_rows, signed), key=key)
    assert sum(r[2] for r in got) > 1000


def test_line_dedup_of_nothing(empty, scratch):
    assert line_dedup.dedup_lines(empty, scratch).collect() == []


def test_line_dedup_is_its_sql(spark):
    directory = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in line_dedup.op2_line_dedup(spark, directory).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())
    duckdb.sql(f"create or replace view documents as from '{directory}/documents.parquet'")
    want = sorted(duckdb.sql(f"select doc_id, n_lines, n_removed, kept_sha256 from ({line_dedup.OP2_SQL})").fetchall())
    assert got == want and any(r[2] for r in got)


def test_fingerprints_are_brute_force(docs, rows, scratch):
    got = [tuple(r) for r in winnowing.with_edits(docs, scratch).collect()]
    assert sorted(got, key=key) == sorted(winnowing.brute_force(rows, signed), key=key)


def test_fingerprints_of_one_and_none(docs, empty, scratch):
    assert winnowing.with_edits(empty, scratch).collect() == []
    (row,) = winnowing.with_edits(docs.where("doc_id = 65"), scratch).collect()
    assert (row.doc_id, row.n_chars, row.near_next) == (65, 3, 1.0)


def test_ranges_keep_the_order(spark, scratch):
    """Many partitions, each of which meets its successor."""
    rows = [((i * 37) % 1009, f"text {i} " + "ab" * (i % 50)) for i in range(1009)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in winnowing.with_edits(docs, scratch, partition_bytes=1000).collect()]
    assert sorted(got) == sorted(winnowing.brute_force(rows, signed))


def test_one_doc_id_fills_many_ranges(spark, scratch):
    """Equal rows, rows of one id and rows without id are cut into ranges like others."""
    rows = [(7, "same text of all these rows " * 3)] * 200 + [(8, f"text {i} of one id " * 3) for i in range(200)] + [(None, f"no id {i % 9}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = [r.n for r in winnowing.in_order(docs, 1000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 150
    got = [tuple(r) for r in winnowing.with_edits(docs, scratch, partition_bytes=1000).collect()]
    assert sorted(got, key=key) == sorted(winnowing.brute_force(rows, signed), key=key)


def test_match_guarantee(rows):
    """Texts that share window + k - 1 code points share a selected hash."""
    import random

    rnd = random.Random(2)
    k, w = 8, 6
    for _ in range(200):
        shared = "".join(rnd.choices("abcd ", k=k + w - 1))
        a, b = ("".join(rnd.choices("efgh ", k=rnd.randint(0, 40))) + shared + "".join(rnd.choices("ijkl", k=rnd.randint(0, 40))) for _ in range(2))
        ha, hb = winnowing.fingerprint(a, k, w)[0], winnowing.fingerprint(b, k, w)[0]
        assert set(ha.tolist()) & set(hb.tolist())


def test_operator_keeps_positions(docs):
    row = next(r for r in winnowing.fingerprints(docs).collect() if r.doc_id == 85)
    assert len(row.hashes) == len(row.positions) > 50  # rightmost of ties: equal grams select each window's last

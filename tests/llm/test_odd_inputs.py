"""Every operator on columns of clashing names, on very long texts and on no rows: defined results, no crash."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, license_scan, line_dedup, lm_scoring, mixing, near_copies, packing, quality_model, quality_rules, simhash, substring_dedup, winnowing
from quern.llm.text import columns_of

CLASHES = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["row", "of", "__row", "__lines", "k", "gone", "all", "th", "h", "l", "n", "s", "w", "b", "m", "t", "fp", "unit", "place", "label", "label2", "chunk", "bucket", "part", "kind", "word", "size", "shard", "words", "cover", "a.b", "kept", "component_id", "license", "perplexity", "epoch", "lines"]


def labels_of(spark):
    return spark.createDataFrame([(i, 1, i) for i in range(40)], "doc_id long, quality int, th int")


OPERATORS = {
    "op1": lambda d, s: license_scan.scan(d, s),
    "op2": lambda d, s: line_dedup.dedup_lines(d, s),
    "op3": lambda d, s: quality_rules.filtered(d, s, min_group=5),
    "op4": lambda d, s: mixing.mixed(d, s),
    "op4_sizes": lambda d, s: mixing.sizes_taken(d, s),
    "op5": lambda d, s: winnowing.with_edits(d, s),
    "op5_prints": lambda d, s: winnowing.fingerprints(d),
    "op6": lambda d, s: quality_model.filtered(d, labels_of(d.sparkSession), s),
    "op7": lambda d, s: bpe.digests(d),
    "op7_ids": lambda d, s: bpe.tokenize(d),
    "op8": lambda d, s: simhash.near_duplicates(d, s),
    "op8_one": lambda d, s: simhash.one_of_each(d, s),
    "op9": lambda d, s: substring_dedup.remove_repeats(d, s),
    "op10": lambda d, s: lm_scoring.score(d, s),
    "op11": lambda d, s: packing.digests(d, s).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")),
    "near": lambda d, s: near_copies.one_of_each(d, s),
}
#: Operators that return the columns of their input.
FILTERS = ("op2", "op3", "op4", "op6", "op8_one", "near")


@pytest.fixture(scope="module")
def clashing(spark, docs):
    base = columns_of(docs, "doc_id", "text", "lang", "source", "n_chars")
    return base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_clashing_names(docs, clashing, scratch, name):
    plain = OPERATORS[name](columns_of(docs, "doc_id", "text", "lang", "source", "n_chars"), scratch)
    out = OPERATORS[name](clashing, scratch)
    if name in FILTERS:
        assert out.columns == clashing.columns
        assert {tuple(r[n] for n in NAMES) for r in out.collect()} == {tuple(range(len(NAMES)))}
    shared = [c for c in plain.columns if c in out.columns]
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in shared]).collect())))
    assert shared == plain.columns and rows(out) == rows(plain)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(clashing, scratch, name):
    assert OPERATORS[name](clashing.where("false"), scratch).collect() == []


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of some megabytes in words and lines, one without any space, and short ones."""
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefghé", k=rnd.randint(2, 9))) for _ in range(5000)]
    prose = "\n".join(" ".join(rnd.choices(vocabulary, k=12)) for _ in range(30_000))
    rows = [(1, prose), (2, "x" * 300_000), (3, prose[: len(prose) // 50]), (4, "short text"), (5, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], CLASHES)


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(long_docs, scratch, name):
    out = OPERATORS[name](long_docs, scratch).collect()
    whole = {r.doc_id: r.text for r in long_docs.collect()}
    by = {r.doc_id: r for r in out}
    n_words = {i: len((t or "").split()) for i, t in whole.items()}
    if name in ("op9", "op10"):
        assert {i: r.n_words for i, r in by.items()} == n_words
    if name == "op9":
        assert by[3].n_removed >= n_words[3] - 2 and by[1].n_removed == 0  # its last word may be cut short
    if name == "op2":
        assert len(by[3].text.split("\n")) <= 2 and by[1].text == whole[1]
    if name == "op4_sizes":
        assert {i: r["size"] for i, r in by.items()} == n_words and all(0 <= r.taken <= 3 * r["size"] for r in out)
    if name == "op5":
        assert {i: r.n_chars for i, r in by.items()} == {i: len(t or "") for i, t in whole.items()}
    if name == "op7_ids":
        assert all(r.decoded == (whole[i] or "") for i, r in by.items())
    if name in ("op3", "op5_prints", "op6", "op7", "op8", "op8_one", "near"):
        assert set(by) <= set(whole)

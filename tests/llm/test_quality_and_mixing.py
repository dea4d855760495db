import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, quality_rules
from tests.llm.conftest import key


def test_base_numbers_are_brute_force(docs, rows, scratch):
    out = quality_rules.judged(docs, scratch, min_group=5)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=key) == sorted(quality_rules.brute_base(rows), key=key)
    assert all(not r.kept for r in out.collect() if r.base_failed)


def test_quality_rules_keep_prose_and_drop_junk(spark, scratch):
    directory = "/root/testdata/sf0.01"
    out = quality_rules.op3_quality_rules(spark, directory)
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    seen = out.join(labels, "doc_id").where("n_words >= 10").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((~F.col("base_failed")).cast("int")).alias("base"))
    share = {r.quality: (r.kept, r.base) for r in seen.collect()}
    assert share[1][0] >= share[1][1] - 0.005  # beyond the base rules, clean documents stay
    assert share[0][0] < 0.6


def test_fences_follow_the_source(spark, scratch):
    """A source where all documents use symbols keeps them; the same document elsewhere goes."""
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    marked = lambda n: " ".join(f"{word()} #{word()}" for _ in range(n))
    plain = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, marked(20), "en", "tags") for i in range(60)] + [(100 + i, plain(40), "en", "prose") for i in range(60)] + [(200, marked(20), "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.kept for r in quality_rules.judged(docs, scratch, min_group=20).collect()}
    assert all(out[i] for i in range(60)) and all(out[100 + i] for i in range(60)) and not out[200]
    assert quality_rules.filtered(docs, scratch, min_group=20).count() == 120


def test_quality_rules_of_nothing(empty, scratch):
    assert quality_rules.judged(empty, scratch).collect() == []
    assert quality_rules.filtered(empty, scratch).collect() == []


def filled(sizes, most=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= weight[s] * share}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("shard_words", [4_000_000, 900])
def test_targets_and_words_taken(docs, rows, scratch, shard_words):
    out = mixing.sizes_taken(docs, scratch, shard_words=shard_words)
    got = out.collect()
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode().split())) for i, t in rows if i is not None)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.sizes_taken(docs.repartition(3), scratch, shard_words=shard_words).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_words_taken_where_blocks_outgrow_shards(spark, scratch):
    """A source of many shards, each smaller than 1 / blocks of the mean source."""
    rows = [(i, "w " * (1 + i * 37 % 400), s) for s, n in (("a", 400), ("b", 60), ("c", 300)) for i in range(n)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.sizes_taken(docs, scratch, blocks=20, shard_words=2500).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s], (s, taken[s], target[s])


def sainte_lague(claims, caps, seats):
    """Seats one by one to the highest quotient; ``claims`` in order of precedence."""
    given = dict.fromkeys(claims, 0)
    order = list(claims)
    for _ in range(seats):
        open_ = [p for p in order if given[p] < caps[p] and claims[p] > 0]
        if not open_:
            break
        best = max(open_, key=lambda p: (claims[p] / (2 * given[p] + 1), -order.index(p)))
        given[best] += 1
    return given


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 333])
def test_quotas_of_sources_are_sainte_lague(spark, scratch, seats):
    rows = [("a", 10.0, 400), ("b", 10.0, 400), ("c", 61.5, 9), ("d", 0.0, 5), (None, 33.0, 400), ("é", 0.4, 400)]
    parties = spark.createDataFrame(rows, "source string, target double, most long")
    totals = spark.createDataFrame([(len(rows), sum(r[1] for r in rows), seats)], "parties long, claims double, seats long")
    got = {r.source: r.quota for r in mixing.apportion(parties, ["source"], "target", "most", "seats", totals, [], scratch).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    assert got == sainte_lague({r[0]: r[1] for r in order}, {r[0]: r[2] for r in order}, seats)


@pytest.mark.parametrize("seed", range(4))
def test_seats_that_full_parties_leave(spark, scratch, seed):
    rnd = random.Random(seed)
    rows = [(g, p, float(rnd.choice([0, 1, 5, 5, 40, 300])), rnd.choice([1, 2, 10, 90])) for g in ("x", None) for p in range(rnd.randint(1, 9))]
    seats = {g: rnd.randint(0, 200) for g in ("x", None)}
    parties = spark.createDataFrame(rows, "source string, shard long, words double, most long")
    totals = spark.createDataFrame([(g, sum(r[0] == g for r in rows), sum(r[2] for r in rows if r[0] == g), n) for g, n in seats.items()], "source string, parties long, claims double, seats long")
    out = mixing.apportion(parties, ["source", "shard"], "words", "most", "seats", totals, ["source"], scratch).collect()
    for g, n in seats.items():
        mine = sorted(r for r in rows if r[0] == g)
        assert {r.shard: r.quota for r in out if r.source == g} == sainte_lague({r[1]: r[2] for r in mine}, {r[1]: r[3] for r in mine}, n)


def test_rows_without_id_are_dealt_to_all_shards(spark, scratch):
    docs = spark.createDataFrame([(None, f"a{i} b c", "s") for i in range(400)], "doc_id long, text string, source string")
    placed, _ = mixing.plan(docs.withColumn("row", F.lit(0).cast("long")), scratch, shard_words=60)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 60


def test_quotas_of_shards_are_sainte_lague(docs, scratch):
    _, shards = mixing.plan(mixing.columns_of(docs, "doc_id", "text", "source").withColumn("row", F.monotonically_increasing_id()), scratch, blocks=300, shard_words=250, shard_blocks=40)
    rows = shards.collect()
    assert len(rows) > 8 and len({r.source for r in rows}) == 4
    for source in {r.source for r in rows}:
        mine = sorted((r for r in rows if r.source == source), key=lambda r: r.shard)
        seats = sum(r.quota for r in mine)
        assert {r.shard: r.quota for r in mine} == sainte_lague({r.shard: r.words for r in mine}, {r.shard: 3 * r.n for r in mine}, seats)
        assert seats <= 3 * sum(r.n for r in mine)


def test_mixed_texts_hold_the_words_taken(docs, scratch):
    taken = mixing.sizes_taken(docs, scratch).agg(F.sum("taken")).first()[0]
    out = mixing.mixed(docs, scratch)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in out.collect()) == taken


def test_one_small_source_stops_at_its_cap(spark, scratch):
    rows = [(i, "w " * 100, "big") for i in range(50)] + [(99, "few words only", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.sizes_taken(docs, scratch).collect()
    assert {r.source: r.target for r in got} == {"big": 4994.0, "zz": 9.0}
    assert next(r.taken for r in got if r.doc_id == 99) == 9


def test_mixing_of_nothing(empty, docs, scratch):
    assert mixing.sizes_taken(empty, scratch).collect() == []
    assert mixing.mixed(empty, scratch).collect() == []
    blank = mixing.sizes_taken(docs.where("doc_id in (62, 63, 64)"), scratch).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 3

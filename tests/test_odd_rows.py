"""Repeats, nulls, ties and no rows in the core operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import aggregates, graph, matching, spans, texts
from quern.plans import detect, gates
from quern.plans import rules as R
from quern.sources import sinks


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_longest_prefix_keeps_repeats(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/c"), (2, "a.b"), (3, None), (4, "a")], "id int, path string")
    prefixes = spark.createDataFrame([("a", "one"), ("a/b", "two"), ("a/b", "more"), (None, "x")], "prefix string, of string")
    assert counted(matching.longest_prefix(rows, prefixes, "path", "prefix")) == {(1, "a/b/c", "a/b", "two"): 2, (4, "a", "a", "one"): 1}
    assert matching.longest_prefix(rows.where("false"), prefixes, "path", "prefix").collect() == []


def test_windows_around_keep_repeats(spark):
    lines = texts.lines_of(spark.createDataFrame([("k", "a\nb\nc"), ("n", None)], "key string, text string"), ["key"])
    points = spark.createDataFrame([("k", 2, "x"), ("k", 2, "x"), ("k", 9, "y"), (None, 1, "z")], "key string, at int, tag string")
    got = counted(texts.windows_around(lines, points, ["key"], "at", 1, 0))
    assert got == {("k", 2, "x", "a\nb"): 2}


@pytest.mark.parametrize("seed", range(3))
def test_snap_is_brute_force(spark, seed):
    rnd = random.Random(seed)
    place = lambda: rnd.choice([None, *range(30)])
    facts = [(rnd.choice(["g", "h", None]), place(), rnd.randrange(3)) for _ in range(120)]
    anchors = [(rnd.choice(["g", None]), place()) for _ in range(9)]
    want = Counter()
    for g, p, t in facts:
        near = [a for ag, a in anchors if g is not None and ag == g and a is not None and p is not None and abs(a - p) <= 2]
        want[g, p, t, min(near, key=lambda a: (abs(a - p), a)) if near else p] += 1
    df, at = spark.createDataFrame(facts, "grp string, pos int, tag int"), spark.createDataFrame(anchors, "grp string, pos int")
    assert counted(spans.snap(df, at, ["grp"], "pos")) == want
    assert counted(spans.snap(df, at.where("false"), ["grp"], "pos")) == Counter({(*f, f[1]): n for f, n in Counter(facts).items()})


def test_preceding_top_is_brute_force(spark):
    rnd = random.Random(7)
    events = [(rnd.choice("ab"), rnd.randrange(15), i) for i in range(40)] * 2
    history = [(rnd.choice("ab"), rnd.choice([None, *range(15)]), i) for i in range(30)]
    want = Counter()
    for g, p, e in events:
        prior = sorted(((q, i) for hg, q, i in history if hg == g and q is not None and q < p), key=lambda x: (-x[0], x[1]))[:3]
        for n, (q, i) in enumerate(prior, 1):
            want[g, p, e, q, i, n] += 1
    df, past = spark.createDataFrame(events, "grp string, pos int, e int"), spark.createDataFrame(history, "grp string, pos int, i int")
    assert counted(spans.preceding_top(df, past, ["grp"], "pos", 3, ["e"], ["i"])) == want


def test_sinks_and_callers_keep_repeats(spark):
    sinks_ = spark.createDataFrame([("s", "f", ["src", "param:0"])] * 2 + [("t", "f", ["lim"]), ("u", None, ["src"])], "sink string, key string, roots array<string>")
    states = spark.createDataFrame([("f", "src", (0, False, 0)), ("f", "param:0", (0, False, 0))], "key string, root string, state struct<origin:int,dispatch:boolean,hops:int>")
    assert counted(graph.reached_sinks(sinks_, states, "roots", ("lim",)).select("sink", "by_root")) == {("s", "param:0"): 2}
    lines = spark.createDataFrame([("a.go", i, "x := run(1)") for i in range(5)], "file string, n int, line string")
    names = spark.createDataFrame([("run",), ("run",)], "name string")
    assert [(r.n, r.truncated) for r in gates.callers_in_text(lines, names, 3).orderBy("n").collect()] == [(0, True), (1, True), (2, True)]
    assert not any(r.truncated for r in gates.callers_in_text(lines, names, 5).collect())


def test_pattern_tables_of_any_size(spark):
    rows = spark.createDataFrame([(i, f"text {i} of p{i % 7} end") for i in range(40)], "id int, text string")
    patterns = spark.createDataFrame([(i, f"p{i}", "k") for i in range(5)], "rank int, pattern string, kind string")
    want = counted(matching.first_pattern(rows, patterns, ["id"], "text"))
    few, matching.FEW = matching.FEW, 2
    try:
        assert counted(matching.first_pattern(rows, patterns, ["id"], "text")) == want and sum(want.values()) > 20
    finally:
        matching.FEW = few


def test_texts_meet_patterns_by_grams(spark):
    import random

    rnd = random.Random(8)
    words = lambda n, most: ["".join(rnd.choices("ab.é\n", k=rnd.randint(0, most))) for _ in range(n)]
    texts_, patterns = [*words(60, 12), None], [*words(30, 5), None, ""]
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "x string")
    few = matching.FEW
    try:
        for matching.FEW in (few, 2):
            got = {tuple(r) for r in matching.contained(rows(texts_), "x", rows(patterns), "x").collect()}
            assert got == {(t, p) for t in texts_ for p in patterns if t is not None and p is not None and p in t}
            related = {r[0] for r in matching.related(rows(texts_), "x", rows(patterns[:6]), "x").collect()}
            assert related == {t for t in texts_ if t is not None and any(p in t or t in p for p in patterns[:6])}
    finally:
        matching.FEW = few


def test_markdown_tells_what_it_leaves(spark):
    rows = spark.range(7).withColumn("x", F.lit("y"))
    assert sinks.markdown(rows, ["id", "x"], ["id"], 5).endswith("| 4 | y |\n\n2 more rows\n") and "more" not in sinks.markdown(rows, ["id"], ["id"], 7)


def test_no_rows(spark):
    t = spark.createDataFrame([], "grp string, pos int, kind string, text string, ord int")
    assert spans.merged_facts(t, t, ["grp"], "pos", "kind", "text").collect() == []
    assert spans.preceding_top(t, t, ["grp"], "pos", 2, ["ord"], []).collect() == []
    assert aggregates.idf(t, "grp", "kind").collect() == []
    assert aggregates.shares(t, "kind").collect() == []


def test_detect_of_nothing(spark):
    from quern.sources import facts

    analysis = spark.createDataFrame([], facts.ANALYSIS.replace("\n", " "))
    assert detect.detected(analysis, detect.Recorded.nothing(spark), R.Rules.of("v2,R1,F3")).collect() == []

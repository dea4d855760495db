import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from quern.llm import near_copies as N
from quern.scratch import Scratch


def jaccard_groups(texts):
    """The group of each text, by comparing all pairs of sets of shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split(" ")
        w = [x for x in w if x]
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def test_groups_are_brute_force(spark, scratch):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]
    texts = [None, "", "  ", "one two", "One  two", "one two three"]
    for _ in range(25):  # copies on both sides of the limit, chains among them
        words = rnd.choices(vocabulary, k=rnd.randint(20, 300))
        for _ in range(8):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 30))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
    want = jaccard_groups(texts)
    assert 40 < len(set(want)) < len(texts) - 40
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    got = [c for _, c in sorted((r["__row"], r.component_id) for r in N.groups(rows, scratch).collect())]
    assert len(got) == len(want) and len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_a_large_group_alike_but_not_enough(spark, scratch):
    """Texts that share most of a passage meet at places; only pairs that may be alike come out, and no link is lost."""
    rnd = random.Random(21)
    passage = [f"p{i}" for i in range(100)]
    texts = [" ".join([*passage, *(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(25, 60)))]) for _ in range(250)]
    for _ in range(150):  # copies of one text, each a few words apart from it, so that many are linked by others only
        words = [*passage, *(f"c{i}" for i in range(80))]
        for _ in range(rnd.randint(2, 5)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    found = {}

    class Noted(Scratch):
        def cut(self, df, name="table", *settings):
            found[name] = super().cut(df, name, *settings)
            return found[name]

    got = [r.component_id for r in sorted(N.groups(rows, Noted(spark)).collect(), key=lambda r: r["__row"])]
    want = jaccard_groups(texts)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) and len(set(want)) > 200
    pairs = found["across"].collect()
    assert len(pairs) == len(set(pairs)) < 0.2 * len(texts) ** 2 / 2


def test_parity_bitmaps_bound_the_difference():
    import numpy as np

    rnd = np.random.RandomState(4)
    for _ in range(50):
        a = np.unique(rnd.randint(0, 1 << 62, rnd.randint(1, 900)).astype(np.uint64) * np.uint64(3))
        b = np.unique(np.concatenate((a[rnd.rand(len(a)) < rnd.rand()], rnd.randint(0, 1 << 62, rnd.randint(1, 300)).astype(np.uint64))))
        apart = sum(bin(int(x)).count("1") for x in (N.parity(a) ^ N.parity(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_stage_drops_near_copies(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    near = [*words[:100], "changed", *words[101:]]
    far = [w if i % 10 else "other" for i, w in enumerate(words)]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert sorted(r.doc_id for r in dict(P.STAGES)["near_copies"](spark, docs, "").collect()) == [0, 2]

import random

from quern.llm import simhash
from tests.llm.conftest import key


def test_near_duplicates_are_brute_force(docs, rows, scratch):
    out = simhash.near_duplicates(docs, scratch)
    got = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in out.collect()]
    assert sorted(got, key=key) == sorted(simhash.brute_force(rows), key=key)


def test_chains_and_large_groups_of_fingerprints(spark, scratch):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    for _ in range(4):  # chains of steps of one to three bits
        x = rnd.getrandbits(64)
        for _ in range(40):
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                x ^= 1 << b
            fps.append(x)
    centre = rnd.getrandbits(64)
    fps += [centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(400)]
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                label[root(i)] = root(j)
    want = {}
    for i in range(len(fps)):
        want.setdefault(root(i), i)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = {r.doc_id: r.component_id for r in simhash.grouped(spark.createDataFrame(signed, "doc_id long, fp long"), scratch).collect()}
    assert got == {i: want[root(i)] for i in range(len(fps))}


def test_one_of_each_group_stays(docs, rows, scratch):
    out = simhash.one_of_each(docs, scratch)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    groups = {c for _, _, c in simhash.brute_force(rows)}
    assert len(kept) == len(groups) + 1 and set(kept) == groups  # two texts of id 82 are groups of their own


def test_nothing(empty, scratch):
    assert simhash.near_duplicates(empty, scratch).collect() == []
    assert simhash.one_of_each(empty, scratch).collect() == []

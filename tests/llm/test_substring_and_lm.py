import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import exchange, lm_scoring, substring_dedup
from quern.llm.hashing import word_hashes
from tests.llm.conftest import key


def test_substring_dedup_is_brute_force(docs, rows, scratch):
    out = substring_dedup.remove_repeats(docs, scratch, chunk_bytes=3000, bucket_bytes=2000)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=key) == sorted(substring_dedup.brute_force(rows), key=key)
    assert sum(r[2] for r in got) > 100


def test_substring_dedup_of_nothing(empty, scratch):
    assert substring_dedup.remove_repeats(empty, scratch).collect() == []


def test_lm_scores_are_brute_force(docs, rows, scratch):
    got = sorted((tuple(r) for r in lm_scoring.score(docs, scratch, chunk_bytes=3000, bucket_bytes=2000).collect()), key=lambda r: key(r[:2] + r[4:]))
    want = sorted(lm_scoring.brute_force(rows), key=lambda r: key(r[:2] + r[4:]))
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    by = lambda x: (str(x[0]), x[1], round(x[2], 6))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by)):
        assert math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)
        assert g[3] is w[3] is None or math.isclose(g[3], w[3], rel_tol=1e-9)


def test_lm_scores_of_nothing(empty, scratch):
    assert lm_scoring.score(empty, scratch).collect() == []


def test_hashes_that_meet_by_chance_are_told_apart():
    """Pairs that share a hash are distinct by their checks, in order and in number."""
    rnd = np.random.RandomState(3)
    hashes, checks = rnd.randint(0, 20, 3000).astype(np.uint64) << np.uint64(58), rnd.randint(0, 5, 3000).astype(np.uint32)
    found = exchange.Distinct(hashes, checks)
    want = sorted(Counter(zip(hashes.tolist(), checks.tolist())).items())
    assert list(zip(zip(found.hashes.tolist(), found.checks.tolist()), found.count.tolist())) == want
    assert (found.hashes[found.number] == hashes).all() and (found.checks[found.number] == checks).all()


def test_checks_alone_tell_words_apart(rows):
    """With hashes of a few values only."""
    texts = [(t or "").encode() for _, t in rows]
    words, checks, _ = word_hashes(texts)
    words = (words % np.uint64(16)) << np.uint64(59)
    assert len(np.unique(words)) <= 16 and len(np.unique(checks)) > 100
    tokens = [w for t in texts for w in t.split()]
    assert len({(a, b) for a, b in zip(words.tolist(), checks.tolist())}) == len(set(tokens)) == len(exchange.Distinct(words, checks))


def test_words_of_all_lengths_and_bytes():
    """Words split as Python splits them, whatever their length; bytes of zero count."""
    rnd = random.Random(9)
    words = [bytes(rnd.choice(b"\x00\x01ab") for _ in range(n)) for n in [*range(1, 300), *[2, 3, 8, 9] * 40]]
    words += [b"a\x00", b"b", b"a", b"a\x00\x00", b"x" * 5000, b"x" * 5001]
    texts = [b" \t".join(words[i : i + 7]) + b"\n" for i in range(0, len(words), 7)]
    hashes, checks, offsets = word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(t.split()) for t in texts]
    tokens = [w for t in texts for w in t.split()]
    for found in (hashes, checks):
        assert len(set(zip(found.tolist(), tokens))) == len(set(tokens)) == len(set(found.tolist()))


def test_a_third_of_all_rows_under_one_key(spark, scratch):
    """Equal rows, rows of one id, rows without id: chunks stay small and results whole."""
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choices([f"w{i}" for i in range(60)], k=n))
    same = prose(40)
    rows = [(7, same)] * 60 + [(8, prose(20) + " " + same) for _ in range(60)] + [(None, prose(30)) for _ in range(60)] + [(100 + i, prose(25)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chunks, size, words = exchange.in_chunks(docs, scratch, 2000)
    held = chunks.collect()
    found = [x for _, ids, texts in exchange.opened(chunks.toArrow()) for x in zip(ids, texts)]
    assert Counter(found) == Counter((i, t.encode()) for i, t in rows) and len({r.chunk for r in held}) == len(held) > 5
    assert max(r.bytes for r in held) <= 2000 and size == sum(len(t) for _, t in rows) and words == sum(len(t.split()) for _, t in rows)
    out = substring_dedup.remove_repeats(docs, scratch, chunk_bytes=2000, bucket_bytes=5000)
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=key) == sorted(substring_dedup.brute_force(rows), key=key)
    by = lambda r: (str(r[0]), r[1], round(r[2], 6), *r[4:])
    assert sorted(map(by, lm_scoring.score(docs, scratch, chunk_bytes=2000, bucket_bytes=5000).collect())) == sorted(map(by, lm_scoring.brute_force(rows)))


def test_very_long_texts(spark, scratch):
    """A text of many chunks' size is a chunk of its own."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(300)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[500:700])), (3, "short"), (4, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(docs, scratch, chunk_bytes=20_000, bucket_bytes=50_000)
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=key) == sorted(substring_dedup.brute_force(rows), key=key)
    by = lambda r: (r[0], r[1], round(r[2], 4), *r[4:])
    assert sorted(map(by, lm_scoring.score(docs, scratch, chunk_bytes=20_000, bucket_bytes=50_000).collect())) == sorted(map(by, lm_scoring.brute_force(rows)))

import math
import random

import numpy as np
import pytest

from quern.llm import quality_model as Q


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries: a function of text to -ln p."""
    from collections import Counter

    start = Q._START * (order - 1)
    tables = {order: Counter((start + t)[i : i + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount = {}
    for k, t in tables.items():
        c = Counter(t.values())
        discount[k] = Q._discounts(c[1], c[2], c[3], c[4])
    alphabet = set(tables[1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(alphabet) + 1)
        t = tables[k]
        same = {g: n for g, n in t.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        d = lambda n: discount[k][min(n, 3) - 1]
        n, total = t.get(gram, 0), sum(same.values())
        return (n - d(n) if n else 0) / total + sum(map(d, same.values())) / total * p(gram[1:])

    def surprise(text):
        text = "".join(c if c in alphabet else Q._UNKNOWN for c in text)
        return sum(-math.log(p((start + text)[i : i + order])) for i in range(len(text)))

    return surprise, p, alphabet


@pytest.mark.parametrize("order", [1, 2, 3])
def test_surprise_is_brute_force(spark, scratch, order):
    rnd = random.Random(order)
    texts = ["".join(rnd.choices("aaabbc dé", k=rnd.randint(1, 40))) for _ in range(25)]
    top = Q.counts(spark.createDataFrame([(t,) for t in texts], "text string"), order)
    table = Q.smoothed(scratch.cut(top), order, scratch).toPandas()
    model = Q.Model(table["gram"].tolist(), table["p"].to_numpy(float), table["w"].to_numpy(float), order)
    want, p, alphabet = plain_model(texts, order)
    tried = [*texts[:5], "", "zzz", "abcde", "é 🙂 a", "c" * 300, ""]
    assert np.allclose(model.surprise(tried), [want(t) for t in tried], rtol=1e-4)
    for context in ("", "a", "ab", "é "):  # probabilities of all characters and the unknown one add to 1
        if len(context) < order:
            assert math.isclose(sum(p(context + c) for c in [*alphabet, Q._UNKNOWN]), 1, rel_tol=1e-9)


def test_keeps_clean_documents_and_rejects_junk(spark, scratch):
    directory = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.judged(docs, labels, scratch, max_train_docs=150).join(labels, "doc_id").collect()
    held_out = {q: [r.kept for r in out if r.quality == q] for q in (0, 1)}
    assert np.mean(held_out[1]) > 0.98
    assert np.mean(held_out[0]) < 0.5


def test_keeps_unlabelled_clean_documents_as_in_production(spark, scratch):
    """Half of the labels are hidden: their good documents must pass with the default parameters."""
    directory = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{directory}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.judged(docs, labels.where("doc_id % 2 = 0"), scratch)
    hidden = out.join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").collect()
    assert len(hidden) > 100 and np.mean([r.kept for r in hidden]) > 0.95


def test_training_documents_and_their_copies_are_not_held_out(spark, scratch):
    labels = spark.createDataFrame([(i, 1) for i in range(21)], "doc_id long, quality int")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(21)] * 3, "doc_id long, text string")
    chosen, held_out = ([r.doc_id for r in x.collect()] for x in Q.split(texts, labels, scratch))
    assert len(chosen) == 10 and set(chosen) | set(held_out) == set(range(21)) and not set(chosen) & set(held_out)
    few, rest = (x.collect() for x in Q.split(texts, labels, scratch, max_train_chars=28))
    assert 3 <= len(few) <= 5 and sum(len(r.text) for r in few) <= 28 and len(few) + len(rest) == 21
    copies = spark.createDataFrame([(i, "the same text", "en") for i in range(21)], "doc_id long, text string, lang string")
    assert {(r.threshold, r.kept) for r in Q.judged(copies, labels, scratch).collect()} == {(None, True)}


def quantile(values, q):
    """The upper end of the first logarithmic bin where q of the values are reached."""
    bins = sorted(max(math.ceil(math.log(v) / math.log(Q._GAMMA)), 0) for v in values)
    return Q._GAMMA ** bins[next(i for i in range(len(bins)) if i + 1 >= len(bins) * q)]


def test_verdicts_are_brute_force(spark, scratch):
    """Prior, medians, thresholds and verdicts from the surprises of the texts."""
    rnd = random.Random(8)
    prose = lambda letters: "".join(rnd.choices(letters, k=rnd.randint(30, 400)))
    rows = [(i, prose("aaaabbbccd "), ["en", "de", "fr"][(i > 60) + (i > 115)]) for i in range(120)]
    rows += [(200 + i, prose("xyzaq!#"), "en") for i in range(20)] + [(300, "", "en"), (301, "a", "de"), (302, None, None), (303, prose("aab"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(118)] + [(200, 0)], "doc_id long, quality int")
    prior, margin, least = 50.0, 1.5, 20
    texts, held_out = Q.split(docs.select("doc_id", "text"), labels, scratch, 40)
    trained = {r.text for r in texts.collect()}
    trusted_ids = {r.doc_id for r in held_out.collect()}
    model = Q.train(texts.select("text"), scratch, 3)
    nats = {i: float(model.surprise([t or ""])[0]) for i, t, _ in rows}
    trusted = [(i, t, lang) for i, t, lang in rows if i in trusted_ids and t not in trained]
    of_lang = lambda lang: [r for r in trusted if r[2] == lang] if sum(r[2] == lang for r in trusted) >= least else trusted
    out = {r.doc_id: r for r in Q.judged(docs, labels, scratch, order=3, max_train_docs=40, prior=prior, margin=margin, min_trusted=least).collect()}
    smooth = {}
    for i, t, lang in rows:
        median = quantile([math.exp(nats[j] / len(u)) for j, u, _ in of_lang(lang)], 0.5)
        smooth[i] = math.exp((nats[i] + prior * math.log(median)) / (len(t or "") + prior))
    for i, t, lang in rows:
        same = [smooth[j] for j, _, _ in of_lang(lang)]
        mid, high = quantile(same, 0.5), quantile(same, 0.99)
        assert math.isclose(out[i].perplexity, smooth[i], rel_tol=1e-4)
        assert math.isclose(out[i].threshold, mid + margin * (high - mid), rel_tol=6e-3)
        if abs(smooth[i] / out[i].threshold - 1) > 1e-3:
            assert out[i].kept == (not t or smooth[i] <= out[i].threshold)
    assert not any(out[200 + i].kept for i in range(20)) and sum(out[i].kept for i in range(118)) > 100


def test_rows_nulls_and_nothing(docs, rows, empty, spark, scratch):
    labels = spark.createDataFrame([(i, 1, "x") for i in range(40)] + [(None, 1, "x"), (41, 0, "x")], "doc_id long, quality int, text string")
    out = Q.judged(docs, labels, scratch).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.chars) for r in out) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    assert all(r.kept for r in out if r.chars == 0)
    again = Q.judged(docs.repartition(3), labels, scratch).collect()
    assert sorted((str(r.doc_id), r.th, r.kept) for r in again) == sorted((str(r.doc_id), r.th, r.kept) for r in out)
    kept = Q.filtered(docs, labels, scratch)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    no_labels = labels.where("false")
    assert Q.filtered(docs, no_labels, scratch).count() == len(rows)
    assert Q.judged(empty, labels, scratch).collect() == []


def test_training_takes_its_whole_share_of_many_documents(spark, scratch):
    n = 6000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    chosen, held_out = Q.split(docs, docs.selectExpr("doc_id", "1 AS quality"), scratch)
    assert (chosen.count(), held_out.count(), chosen.join(held_out, "doc_id").count()) == (n // 2, n // 2, 0)

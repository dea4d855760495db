from collections import Counter

import corpus_pipeline as P


def test_stages_take_effect_and_run_applies_them(spark):
    directory = "/root/testdata/sf0.001"
    original = docs = spark.read.parquet(f"{directory}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, directory).collect(), docs.schema)
        assert docs.columns == original.columns
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    assert labels
    want = Counter(tuple(r) for r in P.STAGES[-1][1](spark, docs, directory).collect())
    assert Counter(tuple(r) for r in P.run(spark, directory).collect()) == want


def labelled(spark, directory):
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, None), (85, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{directory}/labels.parquet")
    return str(directory)


def test_pipeline_of_odd_rows(spark, docs, rows, empty, tmp_path):
    """Nulls, empty texts and repeats pass through every stage; so do no rows."""
    directory = labelled(spark, tmp_path)
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, directory).collect(), docs.schema)
    assert 0 < out.count() <= 3 * len(rows)
    assert P.STAGES[-1][1](spark, out, directory).count() == out.count()
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, empty, directory).collect() == []


def test_stages_chained_without_writing_between(spark, docs, tmp_path):
    """Two chains side by side: no stage loses the tables that a result still reads."""
    directory = labelled(spark, tmp_path)
    one, two = docs, docs.where("doc_id < 70")
    for _, stage in P.STAGES[:-1]:
        one, two = stage(spark, one, directory), stage(spark, two, directory)
    assert 0 < two.count() < one.count()
    assert len(P._made) >= 2

"""The pipeline against a plain version of its stages on a small table."""

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_run_agrees(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(p.STAGES[:-1]):
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == p.COLUMNS
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 3 or docs.count() <= before
    kept = {(r["doc_id"], r["text"]) for r in docs.collect()}
    final = p.run(spark, SF).toPandas()
    assert set(final.doc_id) == {k for k, _ in kept}
    import hashlib

    digests = {(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in kept}
    assert set(zip(final.doc_id, final.decoded_sha256, strict=True)) == digests


def test_near_copies_keep_one_row_of_a_group(spark):
    t, u, v, w = (" ".join(f"{x}{i}" for i in range(60)) for x in "tuvw")
    rows = [(5, t), (5, t), (None, t), (3, t + " end"), (3, u), (9, u + " end"), (None, v), (4, w), (4, w), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(3, t + " end"), (3, u), (None, v), (4, w), (7, ""), (7, "")], key=str)

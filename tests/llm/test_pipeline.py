"""The pipeline over a small table: columns, decisions, round trip."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf01), name)
        assert docs.columns == columns, name
        if name == "quality_classifier":
            good = spark.read.parquet(f"{sf01}/labels.parquet").where("quality = 1").join(before, "doc_id", "left_semi")
            assert docs.join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf01)
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in per)


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs, sf01, tmp_path):
    base = spark.read.parquet(f"{sf01}/documents.parquet").where("doc_id < 120")
    odd = odd_docs.where("doc_id is null or doc_id not in (9, 10)").withColumn("doc_id", F.col("doc_id") + 9000)
    odd.unionByName(base, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    for at in (tmp_path, tmp_path / "none"):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before = {(r.doc_id, r.text) for r in docs.collect()}
            docs = corpus_pipeline.written(stage(spark, docs, sf01), name)
            if name == "harmonic_packing":
                assert (docs.count() > 0) == (n > 0)
                break
            assert docs.columns == columns, name
            after = {(r.doc_id, r.text) for r in docs.collect()}
            assert {i for i, _ in after} <= {i for i, _ in before} and (n == 0) == (not after), name
            if name == "ngram_jaccard_join":
                assert len(after) == docs.count()


def test_kept_rows_by_text(spark):
    # one id with two texts keeps both unless one is a copy; rows without an id leave one of each class
    from jobsignal.llm import ngram_join

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, b), (3, ""), (4, None), (3, "")]
    got = ngram_join.near_duplicates_kept(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, a), (2, b), (None, c), (3, ""), (4, None)]))

"""Corpus pipeline: each stage against its operator's contract, and the whole run."""
import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert 0.5 * n < docs.count() <= n
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_without_rows(spark, sf, make_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), sf).count() == 0, name

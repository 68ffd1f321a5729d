"""The pipeline's stages keep what they should on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, SF))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= before, name
        before = now
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.select("doc_id").distinct().count() == mixed.count() <= before

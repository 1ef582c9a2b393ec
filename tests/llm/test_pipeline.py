"""Stages of the pipeline, one after the other."""

import corpus_pipeline
from lemmata.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.count() > 0, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
        if name == "language ID":
            assert docs.count() >= 0.9 * before.count()
        if name == "secret scans":
            assert docs.count() == before.count()
            assert docs.where("text rlike 'AKIA[A-Z0-9]{12}|[0-9a-f]{32}'").count() == 0
    assert docs.where("size(ids) <> n_tokens").count() == 0


def test_queries_are_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())

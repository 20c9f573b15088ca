"""The corpus pipeline, stage by stage."""

import corpus_pipeline


def test_every_stage_feeds_the_next(spark, sf_dir):
    docs, counts = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from allometra.llm.common import materialise

        docs = materialise(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > 0
    assert not corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).isEmpty()

"""The corpus pipeline's stages, each against what its operator says of its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siltstone.llm import jaccard_join, perplexity_rules, secret_scan

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        ids = {r.doc_id for r in out.collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in perplexity_rules.judge(docs).where("kept").collect()}
        elif name == "ngram_jaccard_join":
            assert ids == {r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
        elif name == "secret_scans":
            assert ids == {r.doc_id for r in docs.collect()}
            assert all(not secret_scan.base_spans(r.text) and r.n_chars == len(r.text) for r in out.collect())
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "a b " * 30_000, None, None, None, 1)]])
def test_odd_tables(spark, tmp_path, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sequence_id long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns

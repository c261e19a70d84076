"""Queries with SQL against their statements, and the pipeline's stages in order, over the given tables."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsflow.llm.catalog import registry, statements
from tests.compare import connect, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", statements())
def test_query_equals_statement(spark, name):
    with connect(SF_DIR) as duck:
        assert spark_rows(registry()[name](spark, SF_DIR)) == duck_rows(duck, statements()[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= count, name
        count = left


def test_pipeline_sends_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    texts = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        dict(corpus_pipeline.STAGES)["bpe"](spark, texts, "")
        found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
    assert sum(found) > 30_000_000 and max(found) < 5_000_000

"""From raw documents to token ids: toxic documents go, copies and near copies go, sources are mixed, texts encoded.

Each stage is a function of (session, documents so far, folder of the given tables) and returns a DataFrame, which is
written to the shared folder and read again as the next stage's documents.

An executor holds whole texts in both directions, in the JVM and in Python, for each core. So the stages lower the session's limit
on the bytes of an Arrow batch (``BATCH_BYTES``; no result depends on it); ``run`` puts it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from newsflow.llm.catalog import tokenizer_path
from newsflow.llm.common import documents, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def in_small_batches(stage: Stage) -> Stage:
    """The stage, after the session was told to send at most ``BATCH_BYTES`` to Python at a time."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@in_small_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


@in_small_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@in_small_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_report(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Scores of misspelled words and BPE have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, before = documents(spark, sf_dir), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs

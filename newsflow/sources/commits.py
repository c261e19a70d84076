"""Several tables written by one batch become visible together or not at all.

Each attempt to write a batch marks its rows with an id of its own. The last write adds one row (run, batch_id, attempt) to
the commit table; readers see only rows whose attempt stands there. An attempt that stops half-way leaves rows that nobody
sees, and a replay of a batch that is committed does nothing. Tables are stored by buckets of their keys (``sources.buckets``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.schemas import ARTICLES, BIAS_RECORDS
from newsflow.sources import buckets as by_bucket
from newsflow.sources.sinks import absent_rows, article_table_rows, read_table, record_table_rows

ATTEMPT = "attempt"
COMMITS = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField(ATTEMPT, T.StringType())]
)


@dataclass(frozen=True)
class Table:
    """Rows for one table. With ``arrival`` its ``key`` is inserted if absent, the first to arrive; else rows always."""

    rows: DataFrame
    key: str
    arrival: Sequence[str] | None = None


def commits(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/commits", COMMITS)


def read_committed(
    spark: SparkSession, path: str, name: str, schema: T.StructType, only: Sequence[int] | None = None
) -> DataFrame:
    """The rows of a table that belong to committed attempts; of some buckets alone if these are given."""
    marked = T.StructType([*schema.fields, T.StructField(ATTEMPT, T.StringType())])
    stored = by_bucket.read_buckets(spark, f"{path}/{name}", marked, only)
    return stored.join(commits(spark, path).select(ATTEMPT), ATTEMPT, "left_semi").select(*schema.names)


def write_together(path: str, run: str, batch_id: int, tables: dict[str, Table], buckets: int) -> bool:
    """Write all tables and commit. False if the batch was committed before; then nothing is written."""
    spark = next(iter(tables.values())).rows.sparkSession
    done = commits(spark, path).filter((F.col("run") == run) & (F.col("batch_id") == batch_id))
    if not done.isEmpty():
        return False
    attempt = uuid.uuid4().hex
    for name, table in tables.items():
        rows = table.rows
        if table.arrival is not None:
            placed = rows.withColumn(by_bucket.BUCKET, by_bucket.bucket_of([table.key], buckets))
            known = read_committed(spark, path, name, rows.schema, by_bucket.touched(placed))
            rows = absent_rows(rows, known, table.key, table.arrival, {})
        rows = rows.withColumn(by_bucket.BUCKET, by_bucket.bucket_of([table.key], buckets))
        by_bucket.write_buckets(rows.withColumn(ATTEMPT, F.lit(attempt)), f"{path}/{name}")
    marker = spark.createDataFrame([(run, batch_id, attempt)], COMMITS)
    marker.coalesce(1).write.mode("append").parquet(f"{path}/commits")  # one file, which appears as a whole
    return True


def analyzed_tables(batch: DataFrame) -> dict[str, Table]:
    """Analyzed messages as articles, inserted if absent, and their score records, always."""
    return {
        "articles": Table(article_table_rows(batch).to(ARTICLES), "article_id", ["ingested_at", "published_at", "title"]),
        "records": Table(record_table_rows(batch).to(BIAS_RECORDS), "record_id"),
    }


def save_analyzed_together(path: str, run: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: articles if absent and their score records always, both or neither."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_together(path, run, batch_id, analyzed_tables(batch), buckets)
        finally:
            batch.unpersist()

    return write

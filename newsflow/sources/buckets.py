"""Tables stored by a hash of their key, so that a batch reads the buckets of its own keys and no others.

A bucket is a folder ``bucket=n``. The folders a batch touches are named in the path it reads, so neither the listing nor the
scan goes over the rest of the table. Null keys have a bucket of their own hash like any other key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


def bucket_of(keys: Sequence[str | Column], buckets: int) -> Column:
    """Bucket of a key, from 0. Keys must have the same types in the table and in the batch."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame) -> list[int]:
    """The buckets that occur in rows with a ``bucket``, ascending; at most as many as there are."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of some buckets (null: of all) with their ``bucket``; none while nothing has been written there."""
    layout = T.StructType([f for f in schema.fields if f.name != BUCKET] + [T.StructField(BUCKET, T.IntegerType())])
    if only is None:
        place = path
    elif only:
        place = f"{path}/{BUCKET}={{{','.join(map(str, only))}}}"
    else:
        return spark.createDataFrame([], layout)
    try:
        return spark.read.schema(layout).option("basePath", path).parquet(place)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], layout)


def write_buckets(rows: DataFrame, path: str, *within: str) -> None:
    """Append rows with a ``bucket``: small buckets share a writer, large ones are split."""
    rows.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET, *within).parquet(path)


def insert_pruned(
    batch: DataFrame, path: str, key: str, fresh_rows: Callable[[DataFrame, DataFrame], DataFrame], buckets: int
) -> None:
    """Append to a table of ``buckets`` buckets what ``fresh_rows(batch, known)`` leaves of the batch.

    ``known`` holds the rows that are stored in the batch's own buckets. The number of buckets is fixed for a table.
    """
    placed = batch.withColumn(BUCKET, bucket_of([key], buckets)).persist()
    try:
        known = read_buckets(batch.sparkSession, path, placed.schema, touched(placed))
        write_buckets(fresh_rows(placed, known), path)
    finally:
        placed.unpersist()

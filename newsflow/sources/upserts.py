"""Upserts as a base table and newer deltas.

Every batch appends one delta: its first appearance and its last row per key. Readers merge the base with the deltas that
it does not cover. The order of messages decides which row is the last one, not the time of writing, so a replay or another run
changes nothing. Compaction writes the merged rows as the next base and then one marker, which names the version and the
deltas covered by it, for each run up to which batch. Readers follow the newest marker; without it a base that was written
half, or whole, does not count. Base and deltas are stored by buckets of the key, so a few keys are found without the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.sources.buckets import BUCKET, bucket_of, touched
from newsflow.sources.sinks import read_table

TOPIC_KEYS = ("topic_name", "platform")
MARKERS = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())]
)


def _reduced(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(BUCKET, *keys).agg(
        F.min("first_seen").alias("first_seen"),
        F.max_by("last_row", "last_seen").alias("last_row"),
        F.max("last_seen").alias("last_seen"),
    )


def upsert_batches(
    path: str,
    run: str,
    keys: Sequence[str] = TOPIC_KEYS,
    order: Sequence[str] = ("updated_at",),
    buckets: int = 16,
    compact_every: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: append each batch reduced to its first appearance and last row per key.

    End ``order`` with a unique column where equal times occur. A replayed batch replaces its rows. ``run`` names the
    checkpoint, as in ``sinks.append_batch``; keys, order and number of buckets are fixed for a table. With
    ``compact_every``, each so many batches begin with a compaction of this run's batches before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if compact_every is not None and batch_id and batch_id % compact_every == 0:
            compact_upserts(batch.sparkSession, path, keys, {run: batch_id - 1})
        arrival = F.struct(*order)
        marked = batch.select(
            bucket_of(keys, buckets).alias(BUCKET),
            *keys,
            arrival.alias("first_seen"),
            F.struct(*batch.columns).alias("last_row"),
            arrival.alias("last_seen"),
        )
        (
            _reduced(marked, keys)
            .withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run", "batch_id", BUCKET)
            .parquet(f"{path}/deltas")
        )

    return write


def _deltas(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/deltas").schema
    named = {"run": T.StringType(), "batch_id": T.LongType(), BUCKET: T.IntegerType()}
    fields = [T.StructField(f.name, named.get(f.name, f.dataType)) for f in stored.fields]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/deltas")


def newest_version(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """Version that readers follow (0: no base yet) and the last batch of each run that it covers."""
    markers = read_table(spark, f"{path}/versions", MARKERS)
    newest = markers.select(F.max("version")).scalar()
    rows = markers.filter(F.col("version") == newest).collect()  # one row for each run
    covered: dict[str, int] = {}
    for row in rows:
        covered[row["run"]] = max(row["batch_id"], covered.get(row["run"], -1))
    return (rows[0]["version"] if rows else 0), covered


def _is_covered(covered: dict[str, int]) -> Column:
    tests = [(F.col("run") == run) & (F.col("batch_id") <= last) for run, last in sorted(covered.items())]
    return reduce(Column.__or__, tests, F.lit(False))


def stored_rows(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """What readers merge: the base of the newest version and the deltas beyond it; of some buckets alone if given."""
    version, covered = newest_version(spark, path)
    deltas = _deltas(spark, path)
    plain = [c for c in deltas.columns if c not in ("run", "batch_id")]
    rows = deltas.filter(~_is_covered(covered)).select(*plain)
    if version:
        base = spark.read.schema(rows.schema).parquet(f"{path}/base/version={version}")
        rows = rows.unionByName(base)
    return rows if only is None else rows.filter(F.col(BUCKET).isin(*only))


def compact_upserts(spark: SparkSession, path: str, keys: Sequence[str] = TOPIC_KEYS, upto: dict[str, int] | None = None) -> int:
    """Write the next version and its marker; the new version.

    ``upto`` names the last batch of each run to be covered, all that is stored if null. A batch that is being written must
    not be among them. Covered deltas and older versions stay where they are, unread.
    """
    version, covered = newest_version(spark, path)
    deltas = _deltas(spark, path)
    if upto is None:
        upto = {r["run"]: r["last"] for r in deltas.groupBy("run").agg(F.max("batch_id").alias("last")).collect()}
    wanted = {run: max(last, covered.get(run, -1)) for run, last in (covered | upto).items()}
    plain = [c for c in deltas.columns if c not in ("run", "batch_id")]
    rows = deltas.filter(_is_covered(wanted) & ~_is_covered(covered)).select(*plain)
    if version:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/base/version={version}"))
    merged = _reduced(rows, keys).select(*plain)
    merged.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/base/version={version + 1}")
    mark_version(spark, path, version + 1, wanted)
    return version + 1


def mark_version(spark: SparkSession, path: str, version: int, covered: dict[str, int]) -> None:
    """Let readers follow a version. One file, which appears as a whole."""
    rows = [(version, run, last) for run, last in sorted(covered.items())]
    spark.createDataFrame(rows, MARKERS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def read_upserted(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = TOPIC_KEYS,
    cap: int | None = None,
    among: DataFrame | None = None,
    buckets: int = 16,
) -> DataFrame:
    """The current row per key. With ``cap``, the keys that appeared most recently.

    ``among`` are rows of keys, few enough to be sent to all tasks, such as those of a page: only their buckets are read.
    """
    if among is None:
        rows = stored_rows(spark, path)
    else:
        wanted = among.select(*keys).withColumn(BUCKET, bucket_of(keys, buckets))
        rows = stored_rows(spark, path, touched(wanted)).join(F.broadcast(wanted), [BUCKET, *keys], "left_semi")
    merged = _reduced(rows, keys)
    if cap is not None:
        merged = merged.orderBy(F.col("first_seen").desc(), *keys).limit(cap)
    return merged.select("last_row.*")

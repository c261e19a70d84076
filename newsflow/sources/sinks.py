"""Table sinks that can be replayed: inserts skip known keys, appends are keyed by run and batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions.bands import FLAT
from newsflow.functions.ids import key_uuid
from newsflow.operators.ingest import accepted, rejected
from newsflow.operators.latest import first_by
from newsflow.operators.windows import to_bursts, to_forecasts
from newsflow.schemas import ARTICLES, BIAS_RECORDS, UNKNOWN_PLATFORM
from newsflow.sources.buckets import insert_pruned

PREDICTION_DEFAULTS = {"platform": UNKNOWN_PLATFORM, "trend_direction": FLAT}

# Layout version, life time and sizes of a snapshot of the recent sets.
SNAPSHOT_VERSION = 1
SNAPSHOT_HOURS = 24
SNAPSHOT_SIZES = {"articles": 50, "bursts": 20, "forecasts": 50}


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})


def absent_rows(
    batch: DataFrame,
    target: DataFrame,
    key: str,
    arrival: Sequence[str | Column],
    defaults: Mapping[str, str] = PREDICTION_DEFAULTS,
) -> DataFrame:
    """Rows an insert-if-absent would add: one per key, the first to arrive, with defaults, unknown to the target.

    Only the target's key column is read. A null key is a key like any other, so a replay meets it again.
    """
    known = target.select(F.col(key).alias("_known"))
    fresh = with_defaults(first_by(batch, [key], arrival), defaults)
    return fresh.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def all_known(batch: DataFrame, target: DataFrame, key: str) -> bool:
    """Whether the target has every key of the batch, so that there is nothing to insert. Only keys are moved."""
    known = target.select(F.col(key).alias("_known"))
    return batch.select(key).join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").isEmpty()


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, empty while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def insert_if_absent(
    batch: DataFrame,
    path: str,
    key: str,
    arrival: Sequence[str | Column],
    day_of: str | None = None,
    defaults: Mapping[str, str] = PREDICTION_DEFAULTS,
    buckets: int | None = None,
) -> None:
    """Append the batch's unknown keys to a parquet table.

    A replayed batch, whose keys are all stored, moves its keys and no other column.
    With ``buckets``, the table is stored by a hash of the key and only the batch's own buckets are read back for the
    key test. With ``day_of``, a time column fixed by the key (a window bound), the table is partitioned by its day and
    only the batch's own span of days is read back for the key test. The rows are rebalanced by day before the
    write: small days share a file writer, a large day is split, and no task opens every day.
    """
    spark = batch.sparkSession
    if buckets is not None:
        insert_pruned(batch, path, key, lambda rows, known: absent_rows(rows, known, key, arrival, defaults), buckets)
        return
    if day_of is None:
        known = read_table(spark, path, batch.schema)
        if not known.isEmpty() and all_known(batch, known, key):
            return
        absent_rows(batch, known, key, arrival, defaults).write.mode("append").parquet(path)
        return
    dated = batch.withColumn("day", F.col(day_of).cast("date")).persist()
    try:
        first, last = dated.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return
        known = read_table(spark, path, dated.schema).filter(F.col("day").between(first, last))
        fresh = absent_rows(dated, known, key, arrival, defaults)
        fresh.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
    finally:
        dated.unpersist()


def append_batch(batch: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Append once per run and batch id: a replayed batch replaces its own rows instead of adding them again.

    ``run`` names the checkpoint that counts the batches, best by the id of its streaming query. Another query over
    the same table, or the same one with a new checkpoint, starts at batch 0 again and must bring a name of its own.
    """
    (
        batch.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "batch_id")
        .parquet(path)
    )


def insert_batches(
    path: str,
    key: str,
    arrival: Sequence[str],
    day_of: str | None = None,
    defaults: Mapping[str, str] = PREDICTION_DEFAULTS,
    buckets: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function around ``insert_if_absent``."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        insert_if_absent(batch, path, key, arrival, day_of, defaults, buckets)

    return write


def save_validated(accepted_path: str, quarantine_path: str, run: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for validated rows: sound ones to one table, the others with their reason to another."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append_batch(accepted(batch), accepted_path, run, batch_id)
            append_batch(rejected(batch), quarantine_path, run, batch_id)
        finally:
            batch.unpersist()

    return write


def article_table_rows(analyzed: DataFrame) -> DataFrame:
    """Analyzed messages as rows of the articles table."""
    published = F.try_to_timestamp("publishedAt")
    return analyzed.select(
        F.col("articleId").alias("article_id"),
        F.col("sourceUrl").alias("source_url"),
        "title",
        "body",
        F.col("sourceName").alias("source_name"),
        published.alias("published_at"),
        F.col("schemaVersion").alias("schema_version"),
        F.try_to_timestamp("analysisTimestamp").alias("ingested_at"),
    )


def record_table_rows(analyzed: DataFrame) -> DataFrame:
    """Analyzed messages as score records, one per message; the id names the article and the analysis time."""
    return analyzed.select(
        key_uuid(F.col("articleId"), F.col("analysisTimestamp")).alias("record_id"),
        F.col("articleId").alias("article_id"),
        F.col("biasScore").alias("bias_score"),
        F.col("biasLabel").alias("bias_label"),
        F.try_to_timestamp("analysisTimestamp").alias("analysis_timestamp"),
        F.col("errorFlag").alias("error_flag"),
    )


def save_analyzed(articles_path: str, records_path: str, run: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: articles if absent, score records always, both from one cached batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            rows = article_table_rows(batch).to(ARTICLES)
            insert_if_absent(rows, articles_path, "article_id", ["ingested_at", "published_at", "title"], None, {})
            append_batch(record_table_rows(batch).to(BIAS_RECORDS), records_path, run, batch_id)
        finally:
            batch.unpersist()

    return write


def save_predictions(
    bursts_path: str, forecasts_path: str, threshold: int
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for directed windows: bursts and forecasts from one windowed aggregate."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.persist()
        try:
            insert_if_absent(to_bursts(batch, threshold), bursts_path, "event_id", ["window_start"], "window_start")
            insert_if_absent(to_forecasts(batch, threshold), forecasts_path, "forecast_id", ["created_at"], "created_at")
        finally:
            batch.unpersist()

    return write


def delivery_rows(deliveries: DataFrame, delivery: Column, delivered_at: Column | None = None) -> DataFrame:
    """Audit rows of delivered messages from (session_id, event_type, article_id).

    ``delivery`` tells repeated deliveries of one message to one session apart: an offset, a number or a time.
    """
    return deliveries.select(
        key_uuid(F.col("session_id"), F.col("event_type"), F.col("article_id"), delivery).alias("log_id"),
        "session_id",
        "event_type",
        F.to_json(F.struct(F.col("article_id").alias("articleId")), {"ignoreNullFields": "false"}).alias("payload"),
        (F.current_timestamp() if delivered_at is None else delivered_at).alias("delivered_at"),
    )


def write_jdbc(batch: DataFrame, url: str, table: str, key: str, arrival: Sequence[str], **options: str) -> None:
    """Insert-if-absent into a database table; the key test reads the key column only."""
    known = batch.sparkSession.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    absent_rows(batch, known, key, arrival).write.format("jdbc").options(url=url, dbtable=table, **options).mode(
        "append"
    ).save()


def write_snapshot(tables: Mapping[str, tuple[DataFrame, str, str]], path: str, saved_at: str) -> None:
    """Save the newest rows of each recent set. ``tables`` maps a name to (rows, newest column, key column)."""
    for name, (df, newest, key) in tables.items():
        rows = df.orderBy(F.col(newest).desc_nulls_last(), F.col(key).asc()).limit(SNAPSHOT_SIZES[name])
        rows.withColumns({"version": F.lit(SNAPSHOT_VERSION), "saved_at": F.lit(saved_at)}).write.mode(
            "overwrite"
        ).parquet(f"{path}/{name}")


def fresh_only(snapshot: DataFrame, now: Column) -> DataFrame:
    """Rows of a readable snapshot: right version, real date, at most a day old. Otherwise none."""
    saved = F.try_to_timestamp("saved_at")
    age_ok = saved >= now.cast("timestamp") - F.make_dt_interval(hours=F.lit(SNAPSHOT_HOURS))
    return snapshot.filter((F.col("version") == SNAPSHOT_VERSION) & age_ok).drop("version", "saved_at")


def read_snapshot(spark: SparkSession, path: str, name: str, now: Column) -> DataFrame:
    return fresh_only(spark.read.parquet(f"{path}/{name}"), now)

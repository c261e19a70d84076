"""Run a streaming query over what its source holds now, then stop."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame

from newsflow.sources.session import fresh_dir


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Write every row the stream emits to parquet and return the table."""
    spark = stream.sparkSession
    place = fresh_dir(spark, "progress") if checkpoint is None else checkpoint
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", place)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Feed every micro-batch to a ``foreachBatch`` function."""
    place = fresh_dir(stream.sparkSession, "progress") if checkpoint is None else checkpoint
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", place)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_quiet(stream: DataFrame, path: str, quiet_ms: int, checkpoint: str | None = None, every_ms: int = 500) -> DataFrame:
    """Write every row to parquet that a stream with timers of processing time emits over what its source holds now.

    Such a query never ends by itself. It is stopped after a batch without input that began more than ``quiet_ms`` past
    the end of the last batch with input: by then every timer set there has fired.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", fresh_dir(spark, "progress") if checkpoint is None else checkpoint)
        .outputMode("append")
        .trigger(processingTime=f"{every_ms} milliseconds")
        .start()
    )
    fed, seen = None, -1
    try:
        while query.isActive:
            for report in query.recentProgress:
                if report.batchId <= seen:
                    continue
                seen, began = report.batchId, datetime.fromisoformat(report.timestamp).timestamp() * 1000
                if report.numInputRows or fed is None:
                    fed = began + report.batchDuration
                elif began > fed + quiet_ms:
                    query.stop()
            time.sleep(every_ms / 5000)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)

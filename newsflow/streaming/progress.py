"""Consumer lag of a running query, from the offsets in its progress reports."""

from __future__ import annotations

import json
import threading
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from newsflow.schemas import END_OFFSETS, OFFSETS


def _positions(value: Any) -> dict[str, dict[str, int]]:
    """Source offsets as {topic: {partition: offset}}; other kinds of source report none."""
    if isinstance(value, str):
        value = json.loads(value)
    if not isinstance(value, dict):
        return {}
    return {topic: parts for topic, parts in value.items() if isinstance(parts, dict)}


def progress_offsets(spark: SparkSession, group: str, progress: Any) -> tuple[DataFrame, DataFrame]:
    """Committed and end offsets of one progress report, ready for ``operators.lag.partition_lag``.

    ``progress`` is ``query.lastProgress``, its JSON or a dictionary. One row per topic partition.
    """
    text = getattr(progress, "json", progress)
    report = json.loads(text) if isinstance(text, str) else text
    committed, ends = [], []
    for source in report["sources"]:
        for topic, parts in _positions(source["endOffset"]).items():
            committed += [(group, topic, int(part), int(offset)) for part, offset in parts.items()]
        for topic, parts in _positions(source["latestOffset"]).items():
            ends += [(topic, int(part), int(offset)) for part, offset in parts.items()]
    return spark.createDataFrame(committed, OFFSETS), spark.createDataFrame(ends, END_OFFSETS)


HISTORY = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("reported_at", T.StringType()),
        T.StructField("input_rows", T.LongType()),
        *OFFSETS.fields,
        T.StructField("end_offset", T.LongType()),
    ]
)


def _number(value: Any) -> int | None:
    """The one number in the offsets of a source without topics, such as the log entry of a file source."""
    if isinstance(value, str):
        value = json.loads(value) if value else None
    if isinstance(value, dict):
        value = next(iter(value.values()), None) if len(value) == 1 else None
    return int(value) if isinstance(value, int | float) else None


def history_rows(group: str, report: dict[str, Any]) -> list[tuple]:
    """One row per topic partition of a progress report. A source without topics is one partition, 0, of its own name."""
    rows = []
    for number, source in enumerate(report["sources"]):
        head = (report["id"], report["batchId"], report["timestamp"], source["numInputRows"], group)
        ends = _positions(source.get("latestOffset"))
        reached = _positions(source["endOffset"])
        for topic, parts in reached.items():
            rows += [(*head, topic, int(p), int(o), ends.get(topic, {}).get(p)) for p, o in parts.items()]
        if not reached:
            rows.append((*head, f"source-{number}", 0, _number(source["endOffset"]), _number(source.get("latestOffset"))))
    return rows


class LagHistory(StreamingQueryListener):
    """Appends the offsets of every progress report of the queries called ``name`` to a parquet table.

    Add it with ``spark.streams.addListener`` before the query starts. A report is a few rows, one per topic partition.
    """

    def __init__(self, spark: SparkSession, path: str, group: str, name: str) -> None:
        self._spark, self._path, self._group, self._name = spark, path, group, name
        self._runs: set[str] = set()
        self._ended = threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        if event.name == self._name:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event: Any) -> None:
        if str(event.progress.runId) in self._runs:
            rows = history_rows(self._group, json.loads(event.progress.json))
            self._spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("append").parquet(self._path)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if str(event.runId) in self._runs:
            self._ended.set()

    def wait(self, seconds: float) -> bool:
        """Wait until the last report of an ended query is written."""
        return self._ended.wait(seconds)


def lag_over_time(history: DataFrame) -> DataFrame:
    """Total lag per group and batch: A5 for every report. An unknown end counts as no lag."""
    behind = F.greatest(F.coalesce(F.col("end_offset") - F.col("committed"), F.lit(0)), F.lit(0))
    return history.groupBy("query_id", "group_id", "batch_id", "reported_at").agg(F.sum(behind).alias("total_lag"))

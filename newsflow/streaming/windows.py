"""Streaming counts, bursts and forecasts, with late rows as data.

Raw rows are first combined within each Arrow batch, by window, title and source, so that a hot topic reaches its key's task
as a few rows of a batch. One stateful processor then keeps the open windows of each key and closes them by timers:

* ``directed_windows`` closes by event time. A timer stands at the end of every open window and fires when the watermark has
  passed it. On a quiet stream the watermark stands still, unless a ``clock`` stream moves it.
* ``quiet_windows`` closes by processing time. A key that has been quiet for ``quiet_ms`` closes all its windows, and before
  that its own newest event closes those that ended ``delay`` before, so no clock is needed and no other key's times matter.

Rows whose window is closed already are not dropped: ``arrivals`` gives them, with ``kind`` = late, beside the windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsflow.functions.bands import direction
from newsflow.operators.windows import (
    DEFAULT_THRESHOLD,
    DEFAULT_WINDOW_MS,
    composite_key,
    named_source,
    to_bursts,
    to_forecasts,
    topic_of,
)
from newsflow.schemas import UNKNOWN_PLATFORM
from newsflow.sources.session import use_rocksdb

WINDOW, LATE = "window", "late"
_PARTS = "window_start long, title string, sourceName string, named string, volume long, scored long, score_sum double, seen long"
_OUT = (
    "kind string, topic_key string, platform string, volume long, avg_bias_score double, "
    "start_ms long, end_ms long, previous_volume long"
)
# Volume, scored rows, sum of scores, time of the last named source, its name.
Tally = tuple[int, int, float, int | None, str | None]
_TALLY = "volume long, scored long, score_sum double, seen long, platform string"


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window, title and source of each Arrow batch."""
    for batch in batches:
        keys = ["window_start", "title", "sourceName", "named"]
        # Rows of a clock carry no message; rows without a time belong to no window.
        told = pa.Table.from_batches([batch.filter(pc.and_(batch.column("_message"), pc.is_valid(batch.column("window_start"))))])
        sums = told.group_by(keys).aggregate([([], "count_all"), ("biasScore", "count"), ("biasScore", "sum"), ("seen", "max")])
        named = sums.select([*keys, "count_all", "biasScore_count", "biasScore_sum", "seen_max"])
        yield from named.rename_columns([*keys, "volume", "scored", "score_sum", "seen"]).combine_chunks().to_batches()


def _partial_counts(analyzed: DataFrame, window_ms: int, delay: str | None, ts: str, clock: DataFrame | None) -> DataFrame:
    rows = analyzed.select("title", "sourceName", "biasScore", ts, F.lit(True).alias("_message"))
    if clock is not None:
        rows = rows.unionByName(clock.select(ts), allowMissingColumns=True)
    if delay is not None:
        rows = rows.withWatermark(ts, delay)
    length = max(1, window_ms // 1000) * 1000
    start = F.unix_millis(F.col(ts).cast("timestamp"))
    parts = rows.select(
        (start - F.pmod(start, F.lit(length))).alias("window_start"),
        "title",
        "sourceName",
        named_source(F.col("sourceName")).alias("named"),
        F.col("biasScore").cast("double").alias("biasScore"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("seen"),
        F.coalesce("_message", F.lit(False)).alias("_message"),
    ).mapInArrow(_combined, _PARTS)
    return parts.withColumn("topic_key", composite_key(F.col("title"), F.col("sourceName")))


def _tally(row: Row) -> Tally:
    seen = row.seen if row.named is not None else None
    return row.volume, row.scored, row.score_sum or 0.0, seen, row.named


def _plus(one: Tally, other: Tally) -> Tally:
    last = max((t[3:] for t in (one, other) if t[3] is not None), default=(None, None))
    return one[0] + other[0], one[1] + other[1], one[2] + other[2], *last


class _Windows(StatefulProcessor):
    """The open windows of one key, and start and volume of the last closed one."""

    def __init__(self, window_ms: int, ttl_ms: int | None = None) -> None:
        self._length = max(1, window_ms // 1000) * 1000
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState("open", "start long", _TALLY)
        self._last = handle.getValueState("last", "start long, volume long")

    def close(self) -> None:
        pass

    def _row(self, kind: str, key: str, start: int, tally: Tally, previous: int | None) -> Row:
        volume, scored, total, _, platform = tally
        mean = total / scored if scored else None
        shown = UNKNOWN_PLATFORM if platform is None else platform
        return Row(
            kind=kind, topic_key=key, platform=shown, volume=volume, avg_bias_score=mean,
            start_ms=start, end_ms=start + self._length, previous_volume=previous,
        )

    def _take(self, key: str, rows: Iterable[Row], edge: int) -> tuple[list[int], list[Row]]:
        """Add rows to their windows; the starts of these, and the rows for windows that are closed or end by ``edge``."""
        last = self._last.get()
        added: dict[int, Tally] = {}
        late: dict[int, Tally] = {}
        for row in rows:
            start = row.window_start
            closed = start + self._length <= edge or (last is not None and start <= last[0])
            into = late if closed else added
            into[start] = _plus(into[start], _tally(row)) if start in into else _tally(row)
        for start, tally in added.items():
            known = self._open.getValue((start,))
            self._open.updateValue((start,), tally if known is None else _plus(tuple(known), tally))
        return list(added), [self._row(LATE, key, start, late[start], None) for start in sorted(late)]

    def _shut(self, key: str, start: int) -> Iterator[Row]:
        """Close the window that begins at ``start``, if it is open. Windows of a key must be closed oldest first."""
        known = self._open.getValue((start,))
        if known is None:
            return
        tally = tuple(known)
        last = self._last.get()
        if last is not None and self._ttl_ms is not None and start >= last[0] + self._length + self._ttl_ms:
            last = None
        self._last.update((start, tally[0]))
        self._open.removeKey((start,))
        yield self._row(WINDOW, key, start, tally, None if last is None else last[1])

    def _shut_all(self, key: str, until: int | None) -> Iterator[Row]:
        """Close the windows that end by ``until`` (null: all)."""
        for start in sorted(k[0] for k in self._open.keys()):
            if until is None or start + self._length <= until:
                yield from self._shut(key, start)


def _key(key: object) -> str:
    return key[0] if isinstance(key, tuple) else key


class ByWatermark(_Windows):
    """A timer at the end of every open window. With ``ttl_ms`` a window that begins so long after the end of its key's last
    one has no window before it, and a timer clears the state of keys that are silent for so long."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added, late = self._take(_key(key), rows, timerValues.getCurrentWatermarkInMs())
        for start in added:
            self._handle.registerTimer(start + self._length)
        yield from late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Timers fire in the order of their times.
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._shut(_key(key), now - self._length)
        last = self._last.get() if self._ttl_ms is not None else None
        if last is not None:
            end = last[0] + self._length + self._ttl_ms
            if end > now:
                self._handle.registerTimer(end)
            else:
                self._last.clear()


class ByQuiet(_Windows):
    """One timer for each key, ``quiet_ms`` past the processing time of its last rows."""

    def __init__(self, window_ms: int, quiet_ms: int, delay_ms: int) -> None:
        super().__init__(window_ms)
        self._quiet_ms, self._delay_ms = quiet_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._seen = handle.getValueState("seen", "newest long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)  # a few for each Arrow batch of the input
        newest, timer = self._seen.get() or (None, None)
        edge = -(1 << 62) if newest is None else newest - self._delay_ms
        _, late = self._take(_key(key), rows, edge)
        yield from late
        if timer is not None:
            self._handle.deleteTimer(timer)
        newest = max([r.seen // 1000 for r in rows] + ([] if newest is None else [newest]))
        timer = timerValues.getCurrentProcessingTimeInMs() + self._quiet_ms
        self._handle.registerTimer(timer)
        self._seen.update((newest, timer))
        yield from self._shut_all(_key(key), newest - self._delay_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest, _ = self._seen.get()
        self._seen.update((newest, None))
        yield from self._shut_all(_key(key), None)


def _arrivals(parts: DataFrame, keeper: _Windows, time_mode: str, name: str) -> DataFrame:
    use_rocksdb(parts.sparkSession)
    kept = parts.groupBy("topic_key").transformWithState(keeper, _OUT, "Append", time_mode)
    bounds = {"window_start": F.timestamp_millis("start_ms"), "window_end": F.timestamp_millis("end_ms")}
    return (
        kept.withColumns(bounds)
        .drop("start_ms", "end_ms")
        .withColumn("topic_name", topic_of(F.col("topic_key")))
        .withColumn("trend_direction", F.when(F.col("kind") == WINDOW, direction(F.col("volume"), F.col("previous_volume"))))
        .observe(
            name,
            F.coalesce(F.sum(F.when(F.col("kind") == WINDOW, F.col("volume"))), F.lit(0)).alias("on_time"),
            F.coalesce(F.sum(F.when(F.col("kind") == LATE, F.col("volume"))), F.lit(0)).alias("late"),
        )
    )


def arrivals(
    analyzed: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    delay: str,
    ttl_ms: int | None = None,
    ts: str = "publishedAt",
    clock: DataFrame | None = None,
) -> DataFrame:
    """Closed windows (``kind`` = window) and what came too late for them (late: rows per key and window of a batch).

    A row is late if its window ends by the watermark, which lies ``delay`` behind the newest time of the batches before.
    Totals of both are observed under the name ``arrivals`` in every progress report. ``clock``, a stream whose column ``ts``
    tells the time, moves the watermark of a quiet or bounded stream; its rows are counted nowhere. It must not run ahead of
    messages to come: for a bounded input it is one row past the end, for a live one the present time less the usual delay.
    """
    parts = _partial_counts(analyzed, window_ms, delay, ts, clock)
    return _arrivals(parts, ByWatermark(window_ms, ttl_ms), "EventTime", "arrivals")


def quiet_arrivals(
    analyzed: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    quiet_ms: int,
    delay_ms: int,
    ts: str = "publishedAt",
) -> DataFrame:
    """Like ``arrivals``, but windows close by themselves: ``quiet_ms`` after the last rows of their key.

    A row is late if its window ends ``delay_ms`` or more before the newest time that its key had in earlier batches, or if
    the key has closed it in a quiet spell. Such a query runs batches without end; give it a processing-time trigger, and
    ``streaming.run.drain_quiet`` for a bounded input.
    """
    parts = _partial_counts(analyzed, window_ms, None, ts, None)
    return _arrivals(parts, ByQuiet(window_ms, quiet_ms, delay_ms), "ProcessingTime", "arrivals")


def on_time(arrived: DataFrame) -> DataFrame:
    """The closed windows, as ``operators.windows.with_direction`` has them."""
    return arrived.filter(F.col("kind") == WINDOW).drop("kind")


def too_late(arrived: DataFrame) -> DataFrame:
    """What came too late: key, window and number of rows."""
    return arrived.filter(F.col("kind") == LATE).select("topic_key", "topic_name", "window_start", "window_end", "volume")


def directed_windows(
    analyzed: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    delay: str,
    ttl_ms: int | None = None,
    ts: str = "publishedAt",
    clock: DataFrame | None = None,
) -> DataFrame:
    """The one aggregate that feeds bursts and forecasts alike, closed by event time."""
    return on_time(arrivals(analyzed, window_ms, delay=delay, ttl_ms=ttl_ms, ts=ts, clock=clock))


def quiet_windows(
    analyzed: DataFrame, window_ms: int = DEFAULT_WINDOW_MS, *, quiet_ms: int, delay_ms: int, ts: str = "publishedAt"
) -> DataFrame:
    """The one aggregate that feeds bursts and forecasts alike, closed by timers of processing time."""
    return on_time(quiet_arrivals(analyzed, window_ms, quiet_ms=quiet_ms, delay_ms=delay_ms, ts=ts))


def stream_bursts(
    analyzed: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    delay: str,
    clock: DataFrame | None = None,
) -> DataFrame:
    return to_bursts(directed_windows(analyzed, window_ms, delay=delay, clock=clock), threshold)


def stream_forecasts(
    analyzed: DataFrame,
    baseline: int = DEFAULT_THRESHOLD,
    window_ms: int = DEFAULT_WINDOW_MS,
    *,
    delay: str,
    clock: DataFrame | None = None,
) -> DataFrame:
    return to_forecasts(directed_windows(analyzed, window_ms, delay=delay, clock=clock), baseline)

"""Windowed topic counts, burst detection and volume forecasts.

The plan counts raw rows with a hash aggregate on (window, title, source): all its buffers have fixed width,
so it combines before the shuffle and a hot topic reaches its reducer as one row per input partition. The few
resulting rows are then spread once by composite key and month, which serves both the second aggregate and
``lag``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.functions.bands import direction
from newsflow.functions.ids import key_uuid
from newsflow.functions.text import is_blank
from newsflow.functions.times import parse_iso, plus_hours
from newsflow.schemas import UNKNOWN_PLATFORM, UNKNOWN_TOPIC

# Default burst threshold (also the forecast baseline) and window length.
DEFAULT_THRESHOLD = 50
DEFAULT_WINDOW_MS = 60_000


def window_length(window_ms: int) -> str:
    """Whole seconds, at least one."""
    return f"{max(1, window_ms // 1000)} seconds"


def composite_key(title: Column, source: Column) -> Column:
    """``title|source`` with stand-ins for nulls. Titles holding a bar may share a key with another pair."""
    return F.concat(
        F.coalesce(title, F.lit(UNKNOWN_TOPIC)), F.lit("|"), F.coalesce(source, F.lit(UNKNOWN_PLATFORM))
    )


def topic_of(key: Column) -> Column:
    """The part before the first bar."""
    return F.substring_index(key, "|", 1)


def with_event_time(
    analyzed: DataFrame,
    ts: str = "publishedAt",
    fallback: str = "analysisTimestamp",
    ahead: str = "1 day",
    received: str | None = None,
) -> DataFrame:
    """Turn the publication text into a timestamp; where it is no real date, the analysis time stands in.

    A time more than ``ahead`` past the analysis can't be true, or one such message would move the watermark of a stream past
    all others; the analysis time stands in there too. ``received`` names a timestamp of the broker, which takes the place
    of a missing analysis time. Where nothing bounds the publication time it is not believed, and the row has no time:
    windows leave it out, and ``without_event_time`` gives it.
    """
    told, analysed = parse_iso(F.col(ts)), parse_iso(F.col(fallback))
    bound = analysed if received is None else F.coalesce(analysed, F.col(received))
    believed = F.when(told <= bound + F.expr(f"INTERVAL {ahead}"), told)
    return analyzed.withColumn(ts, F.coalesce(believed, bound))


def without_event_time(timed: DataFrame, ts: str = "publishedAt") -> DataFrame:
    """The rows that ``with_event_time`` could give no time, for the rejected output."""
    return timed.filter(F.col(ts).isNull())


def named_source(source: Column) -> Column:
    """The source if it has a visible name, else null."""
    return F.when(~is_blank(source), source)


def _month(window_start: Column) -> Column:
    return F.trunc(window_start, "month")


def _per_source(analyzed: DataFrame, window_ms: int, slide_ms: int | None, ts: str) -> DataFrame:
    slide = None if slide_ms is None else window_length(slide_ms)
    span = F.window(F.col(ts), window_length(window_ms), slide)
    return analyzed.groupBy(span.alias("span"), F.col("title"), F.col("sourceName")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("biasScore").alias("scored"),
        F.sum("biasScore").alias("score_sum"),
        F.max(ts).alias("last_seen"),
    )


def window_counts(
    analyzed: DataFrame,
    window_ms: int = DEFAULT_WINDOW_MS,
    slide_ms: int | None = None,
    ts: str = "publishedAt",
) -> DataFrame:
    """One row per composite key and non-empty window: volume, mean score, shown platform, bounds.

    Windows tumble and are aligned to the epoch; ``slide_ms`` makes them slide. The platform is the last
    non-blank source in the window by time (equal times: the greater name), else ``Unknown``.
    ``window_month`` is the layout of the result: all windows of a key and month share a partition.
    """
    named = named_source(F.col("sourceName"))
    return (
        _per_source(analyzed, window_ms, slide_ms, ts)
        .withColumn("topic_key", composite_key(F.col("title"), F.col("sourceName")))
        .withColumn("window_month", _month(F.col("span.start")))
        .repartition("topic_key", "window_month")
        .groupBy("topic_key", "window_month", "span")
        .agg(
            F.sum("n").alias("volume"),
            (F.sum("score_sum") / F.sum("scored")).alias("avg_bias_score"),
            F.coalesce(
                F.max_by(named, F.when(named.isNotNull(), F.struct("last_seen", "sourceName"))),
                F.lit(UNKNOWN_PLATFORM),
            ).alias("platform"),
        )
        .select(
            "topic_key",
            topic_of(F.col("topic_key")).alias("topic_name"),
            "platform",
            "volume",
            "avg_bias_score",
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "window_month",
        )
    )


def with_direction(counts: DataFrame) -> DataFrame:
    """Add the previous non-empty window's volume of the same key and the direction against it.

    A key that never stops would put its whole history into one task, so ``lag`` runs within each month of a
    key. The first window of a month takes the last volume of the key's month before, found by a second
    ``lag`` over one row per key and month. The counts are laid out by key and month already and do not move.
    """
    by_month = ["topic_key", "window_month"]
    in_month = W.partitionBy(*by_month).orderBy("window_start")
    over_months = W.partitionBy("topic_key").orderBy("window_month")
    lagged = counts.withColumn("_before", F.lag("volume").over(in_month))
    # Whole rows, though only the volume is wanted: with equal columns (and no filter from an inner join) both
    # uses of the counts are the same plan, and Spark runs the scan and its shuffles once.
    closing = counts.groupBy(*by_month).agg(F.max_by(F.struct(*counts.columns), "window_start").alias("_closing"))
    carried = closing.select(*by_month, F.lag("_closing.volume").over(over_months).alias("_carried"))
    return (
        lagged.join(carried, by_month, "left")
        .withColumn("previous_volume", F.coalesce("_before", "_carried"))
        .withColumn("trend_direction", direction(F.col("volume"), F.col("previous_volume")))
        .drop("_before", "_carried", "window_month")
    )


def to_bursts(directed: DataFrame, threshold: int = DEFAULT_THRESHOLD, detected_at: Column | None = None) -> DataFrame:
    """Windows above the threshold as burst events. Directions already look past windows below it."""
    return directed.filter(F.col("volume") > threshold).select(
        key_uuid(F.lit("burst"), F.col("topic_key"), F.col("window_start"), F.col("window_end")).alias("event_id"),
        "topic_name",
        "platform",
        F.col("volume").alias("article_count"),
        "avg_bias_score",
        "trend_direction",
        "window_start",
        "window_end",
        (F.col("window_end") if detected_at is None else detected_at).alias("detection_timestamp"),
    )


def to_forecasts(directed: DataFrame, baseline: int = DEFAULT_THRESHOLD, created_at: Column | None = None) -> DataFrame:
    """Every window as a forecast: the same volume again, confidence growing with it up to the baseline."""
    volume = F.col("volume").cast("double")
    if baseline > 0:
        confidence = F.least(F.lit(1.0), volume / F.lit(float(baseline)))
    else:
        confidence = F.when(volume > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return directed.select(
        key_uuid(F.lit("forecast"), F.col("topic_key"), F.col("window_start"), F.col("window_end")).alias("forecast_id"),
        "topic_name",
        "platform",
        volume.alias("predicted_volume"),
        confidence.alias("confidence_score"),
        "avg_bias_score",
        "trend_direction",
        plus_hours(F.col("window_end")).alias("forecast_horizon"),
        (F.col("window_end") if created_at is None else created_at).alias("created_at"),
    )


def burst_detection(
    analyzed: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    window_ms: int = DEFAULT_WINDOW_MS,
    slide_ms: int | None = None,
    ts: str = "publishedAt",
) -> DataFrame:
    return to_bursts(with_direction(window_counts(analyzed, window_ms, slide_ms, ts)), threshold)


def trend_forecast(
    analyzed: DataFrame,
    baseline: int = DEFAULT_THRESHOLD,
    window_ms: int = DEFAULT_WINDOW_MS,
    slide_ms: int | None = None,
    ts: str = "publishedAt",
) -> DataFrame:
    return to_forecasts(with_direction(window_counts(analyzed, window_ms, slide_ms, ts)), baseline)

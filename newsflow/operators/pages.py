"""Pages, keyset pages and capped recent sets.

``page_of`` is a distributed top-k, which carries ``offset + size`` rows and suits pages near the top.
``page_by_position`` finds a page far down by counts per day and second and sorts what is left; the caller picks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.functions.bands import percent
from newsflow.functions.times import instant
from newsflow.operators.latest import latest_scores
from newsflow.operators.predictions import predictions_union
from newsflow.operators.trending import trending_topics

# Page defaults and bounds.
DEFAULT_PAGE, DEFAULT_SIZE, MAX_SIZE = 1, 20, 100

DAY_MICROS, SECOND_MICROS = 86_400_000_000, 1_000_000

# Sizes of the recent sets kept per kind.
RECENT_ARTICLES, RECENT_BURSTS, RECENT_FORECASTS, RECENT_SIGNALS, RECENT_TOPICS = 200, 20, 50, 100, 100


def clamp(page: int | None = None, size: int | None = None) -> tuple[int, int]:
    """Page at least 1; size between 1 and 100."""
    page = DEFAULT_PAGE if page is None else page
    size = DEFAULT_SIZE if size is None else size
    return max(1, page), max(1, min(size, MAX_SIZE))


def _newest_first(newest: str, key: str) -> list[Column]:
    return [F.col(newest).desc_nulls_last(), F.col(key).asc()]


def page_of(df: DataFrame, newest: str, key: str, page: int | None = None, size: int | None = None) -> DataFrame:
    """Page ``page`` in descending order of ``newest``, equal times by ascending ``key``."""
    page, size = clamp(page, size)
    return df.orderBy(*_newest_first(newest, key)).offset((page - 1) * size).limit(size)


def page_by_position(df: DataFrame, newest: str, key: str, page: int | None = None, size: int | None = None) -> DataFrame:
    """The page of ``page_of``, found by counting instead of sorting all rows above it. Runs two small jobs.

    Rows per day, one number for each day of the calendar, say by their running sum which days the page falls into; rows per
    second say the same within these. What is left, as a range of ``newest`` that reaches the scan, is sorted. Rows without
    a time come last. Rows with equal time and key are ordered by a hash of their columns, so that each is on one page.
    """
    page, size = clamp(page, size)
    offset = (page - 1) * size
    micros = F.unix_micros(F.col(newest).cast("timestamp"))
    rows, skipped = df, 0
    for unit in (DAY_MICROS, SECOND_MICROS):
        start = (micros - F.pmod(micros, F.lit(unit))).alias("_start")
        counts = rows.groupBy(start).agg(F.count(F.lit(1)).alias("_rows"))
        # At most one row for each day, then 86,400 for each of the days found.
        running = F.sum("_rows").over(W.orderBy(F.col("_start").desc_nulls_last()))
        above = counts.withColumn("_above", skipped + running - F.col("_rows"))
        here = above.filter((F.col("_above") < offset + size) & (F.col("_above") + F.col("_rows") > offset))
        found = here.agg(F.min("_start"), F.max("_start"), F.count_if(F.col("_start").isNull()), F.min("_above")).first()
        low, high, without, first = found
        if first is None:
            return df.limit(0)
        skipped = first
        kept = F.lit(False)
        if low is not None:
            bounds = [F.timestamp_micros(F.lit(m)).cast(df.schema[newest].dataType) for m in (low, high + unit)]
            kept = (F.col(newest) >= bounds[0]) & (F.col(newest) < bounds[1])
        rows = df.filter(kept | F.col(newest).isNull() if without else kept)
    order = [*_newest_first(newest, key), F.xxhash64(*df.columns)]
    return rows.orderBy(*order).offset(offset - skipped).limit(size)


def page_after(
    df: DataFrame, newest: str, key: str, last: tuple[datetime, str] | None, size: int | None = None
) -> DataFrame:
    """Keyset page: the rows after ``last = (time, key)`` of the page before; ``None`` starts at the top.

    Costs the same on every page, and the time bound reaches the scan as a pushed filter.
    """
    _, size = clamp(None, size)
    if last is not None:
        time, ident = instant(last[0]), F.lit(last[1])
        df = df.filter((F.col(newest) <= time) & ((F.col(newest) < time) | (F.col(key) > ident)))
    return df.orderBy(F.col(newest).desc_nulls_last(), F.col(key).asc()).limit(size)


def articles_page(
    articles: DataFrame, bias_records: DataFrame, page: int | None = None, size: int | None = None
) -> DataFrame:
    """Newest articles with their latest score.

    The order needs times and ids only, so the page is cut from these; bodies and records are then read for its
    articles alone: at most 100 ids, which is why that side may be broadcast.
    """
    times = articles.select("published_at", "article_id")
    ids = F.broadcast(page_of(times, "published_at", "article_id", page, size).select("article_id"))
    shown = articles.join(ids, "article_id", "left_semi")
    scores = latest_scores(bias_records.join(ids, "article_id", "left_semi"))
    return shown.join(F.broadcast(scores), "article_id", "left").orderBy(
        F.col("published_at").desc_nulls_last(), F.col("article_id").asc()
    )


def article_by_id(articles: DataFrame, article_id: str) -> DataFrame:
    return articles.filter(F.col("article_id") == article_id)


def bias_records_page(bias_records: DataFrame, page: int | None = None, size: int | None = None) -> DataFrame:
    return page_of(bias_records, "analysis_timestamp", "record_id", page, size)


def predictions_page(
    bursts: DataFrame, forecasts: DataFrame, page: int | None = None, size: int | None = None
) -> DataFrame:
    return page_of(predictions_union(bursts, forecasts), "created_at", "id", page, size)


def trending_page(
    bursts: DataFrame, forecasts: DataFrame, page: int | None = None, size: int | None = None
) -> DataFrame:
    """Most recently updated topics; equal times by topic and platform."""
    topics = trending_topics(bursts, forecasts).withColumn("_key", F.struct("topic_name", "platform"))
    return page_of(topics, "updated_at", "_key", page, size).drop("_key")


def forecast_panel(forecasts: DataFrame) -> DataFrame:
    """Forecasts by horizon, confidence as whole percent."""
    return forecasts.orderBy("forecast_horizon", "forecast_id").select(
        F.col("topic_name").alias("name"),
        "predicted_volume",
        percent(F.col("confidence_score")).alias("confidence_percent"),
        "forecast_horizon",
        "forecast_id",
    )


def recent(df: DataFrame, newest: str, key: str, size: int) -> DataFrame:
    """The ``size`` newest rows, for a recent set whose cap is its definition."""
    return df.orderBy(F.col(newest).desc_nulls_last(), F.col(key).asc()).limit(size)


def articles_from(articles: DataFrame, source: str | None) -> DataFrame:
    """Articles of one source; no source selected gives none."""
    return articles.filter(F.lit(False) if source is None else F.col("source_name") == source)


def articles_from_any(articles: DataFrame, sources: Sequence[str]) -> DataFrame:
    return articles.filter(F.col("source_name").isin(*sources) if sources else F.lit(False))

"""Latest row per key, first row per key, and the joins built on them.

All reductions combine before the shuffle, so a key that holds a third of all rows sends one row per input
partition instead of its whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` per key. End ``order`` with a unique column for stable results."""
    kept = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_row")).select("_row.*")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the smallest ``order`` per key: first arrival wins."""
    kept = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_row")).select("_row.*")


def latest_bursts(bursts: DataFrame) -> DataFrame:
    return latest_by(bursts, ["topic_name", "platform"], ["detection_timestamp", "event_id"])


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    return latest_by(forecasts, ["topic_name", "platform"], ["created_at", "forecast_id"])


def forecasts_without_burst(forecasts: DataFrame, bursts: DataFrame) -> DataFrame:
    """Forecasts whose (topic, platform) has no burst at all."""
    keys = ["topic_name", "platform"]
    return forecasts.join(bursts.select(*keys).distinct(), keys, "left_anti")


def latest_scores(bias_records: DataFrame) -> DataFrame:
    """Score and label of the most recent record per article (equal times: the greater record id)."""
    newest = F.max_by(
        F.struct("bias_score", "bias_label"), F.struct("analysis_timestamp", "record_id")
    )
    return bias_records.groupBy("article_id").agg(newest.alias("_row")).select(
        "article_id", "_row.bias_score", "_row.bias_label"
    )


def with_latest_score(articles: DataFrame, bias_records: DataFrame) -> DataFrame:
    """Every article with its latest score, nulls when it has none.

    Both sides are unique on ``article_id`` by the time they meet, so this join cannot skew.
    """
    return articles.join(latest_scores(bias_records), "article_id", "left")


def orphan_records(bias_records: DataFrame, articles: DataFrame) -> DataFrame:
    """Records that point to no article. The reference column is never null.

    One article may own a large part of all records; Spark splits such a partition of the left side at run time.
    """
    return bias_records.join(articles.select("article_id"), "article_id", "left_anti")


def cascade_records(bias_records: DataFrame, articles: DataFrame) -> DataFrame:
    """Records that survive when those of deleted articles go with them."""
    return bias_records.join(articles.select("article_id"), "article_id", "left_semi")

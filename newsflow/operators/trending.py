"""Trending topics: the latest burst per topic and platform, or the latest forecast where there is no burst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.functions.bands import risk_level, score_text, volume_text, whole_volume
from newsflow.operators.latest import forecasts_without_burst, latest_bursts, latest_forecasts


def _project(df: DataFrame, volume: str, updated: str, ident: str | None = None) -> DataFrame:
    return df.select(
        *([] if ident is None else [F.col(ident).alias("id")]),
        "topic_name",
        "platform",
        whole_volume(F.col(volume)).alias("volume"),
        "avg_bias_score",
        "trend_direction",
        risk_level(F.col("avg_bias_score")).alias("risk_level"),
        F.col(updated).alias("updated_at"),
    )


def trending_updates(bursts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every burst and forecast as an update of its topic's row, for upserting; ``id`` orders equal times."""
    return _project(bursts, "article_count", "detection_timestamp", "event_id").unionByName(
        _project(forecasts, "predicted_volume", "created_at", "forecast_id")
    )


def trending_topics(bursts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per (topic, platform). The anti join meets two already reduced sides."""
    burst_rows = latest_bursts(bursts)
    forecast_rows = forecasts_without_burst(latest_forecasts(forecasts), burst_rows)
    return _project(burst_rows, "article_count", "detection_timestamp").unionByName(
        _project(forecast_rows, "predicted_volume", "created_at")
    )


def display_text(trending: DataFrame) -> DataFrame:
    """Volume and score as shown in the table."""
    return trending.select(
        "topic_name",
        "platform",
        volume_text(F.col("volume")).alias("volume_text"),
        score_text(F.col("avg_bias_score")).alias("score_text"),
        F.upper("risk_level").alias("risk_text"),
        "trend_direction",
    )

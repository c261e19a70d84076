"""Bursts and forecasts as one list, and the mapping of served rows to client records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.times import iso_text
from newsflow.schemas import BURST, FORECAST


def predictions_union(bursts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Both kinds in one 13-column table, told apart by ``type``; columns of the other kind are null."""
    burst_rows = bursts.select(
        F.lit(BURST).alias("type"),
        F.col("event_id").alias("id"),
        "topic_name",
        "platform",
        "article_count",
        "avg_bias_score",
        "trend_direction",
        "window_start",
        "window_end",
        F.col("detection_timestamp").alias("created_at"),
    )
    forecast_rows = forecasts.select(
        F.lit(FORECAST).alias("type"),
        F.col("forecast_id").alias("id"),
        "topic_name",
        "platform",
        "avg_bias_score",
        "trend_direction",
        "created_at",
        "predicted_volume",
        "confidence_score",
        iso_text(F.col("forecast_horizon")).alias("forecast_horizon"),
    )
    return burst_rows.unionByName(forecast_rows, allowMissingColumns=True)


def only(predictions: DataFrame, kind: str) -> DataFrame:
    return predictions.filter(F.col("type") == kind)


def article_rows(articles: DataFrame, now: Column) -> DataFrame:
    """Served articles as client records with their defaults; ``now`` stands in for a missing time."""
    return articles.select(
        F.coalesce("article_id", F.lit("")).alias("articleId"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("source_name", F.lit("Unknown")).alias("sourceName"),
        iso_text(F.coalesce("published_at", now)).alias("publishedAt"),
        F.col("bias_score").alias("biasScore"),
    )


def burst_rows(predictions: DataFrame, now: Column) -> DataFrame:
    return only(predictions, BURST).select(
        F.coalesce("id", F.lit("")).alias("eventId"),
        F.coalesce("topic_name", F.lit("")).alias("topicName"),
        F.coalesce("article_count", F.lit(0)).alias("articleCount"),
        F.coalesce(iso_text(F.col("window_start")), F.lit("")).alias("windowStart"),
        F.coalesce(iso_text(F.col("window_end")), F.lit("")).alias("windowEnd"),
        iso_text(F.coalesce("created_at", now)).alias("detectionTimestamp"),
    )


def forecast_rows(predictions: DataFrame) -> DataFrame:
    return only(predictions, FORECAST).select(
        F.coalesce("id", F.lit("")).alias("forecastId"),
        F.coalesce("topic_name", F.lit("")).alias("topicName"),
        F.coalesce("predicted_volume", F.lit(0.0)).alias("predictedVolume"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidenceScore"),
        F.coalesce("forecast_horizon", F.lit("")).alias("forecastHorizon"),
    )

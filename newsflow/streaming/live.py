"""Streaming deduplication, upsert, and the live tables fed by both outgoing topics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.ingest import drop_malformed
from newsflow.operators.live import normalize_trending, route_messages, routed, tag_messages
from newsflow.schemas import ARTICLE, BURST, FORECAST, TRENDING
from newsflow.sources.sinks import insert_if_absent
from newsflow.sources.upserts import read_upserted, upsert_batches


def dedup_stream(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First arrival per id, remembering ids for ``delay`` of event time."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _texts(document: str, *names: str) -> list[Column]:
    return [F.try_variant_get(document, f"$.{name}", "string").alias(name) for name in names]


def _numbers(document: str, *names: str) -> list[Column]:
    return [F.try_variant_get(document, f"$.{name}", "double").alias(name) for name in names]


def live_tables(batch: DataFrame, now: Column, arrival: Sequence[str]) -> dict[str, DataFrame]:
    """Messages (topic, value) as the rows of the four live tables, by name; malformed messages fall out.

    Every prediction that names a topic also gives a trending row, whatever its own kind.
    """
    received = drop_malformed(batch)
    routes = route_messages(tag_messages(received))

    def fields(route: str, *columns: Column) -> DataFrame:
        return routed(routes, route).select(*columns, *arrival)

    doc = "document"
    trending = normalize_trending(received, now, keep=arrival).drop("type")
    sent = routed(routes, TRENDING).select(
        *_texts(doc, "topic_name", "platform"),
        *_numbers(doc, "volume", "avg_bias_score"),
        *_texts(doc, "trend_direction", "risk_level", "updated_at"),
        *arrival,
    )
    return {
        "articles": fields(
            ARTICLE, *_texts(doc, "articleId", "title", "sourceName", "publishedAt"), *_numbers(doc, "biasScore")
        ),
        "bursts": fields(
            BURST,
            *_texts(doc, "eventId", "topicName", "platform"),
            *_numbers(doc, "articleCount", "avgBiasScore"),
            *_texts(doc, "trendDirection", "windowStart", "windowEnd", "detectionTimestamp"),
        ),
        "forecasts": fields(
            FORECAST,
            *_texts(doc, "forecastId", "topicName", "platform"),
            *_numbers(doc, "predictedVolume", "confidenceScore", "avgBiasScore"),
            *_texts(doc, "trendDirection", "forecastHorizon"),
        ),
        "trending": trending.unionByName(sent),
    }


# Key per live table; trending rows are upserted, the others inserted if absent.
LIVE_KEYS = {"articles": "articleId", "bursts": "eventId", "forecasts": "forecastId"}
LIVE_BUCKETS = 16


def save_live(path: str, run: str, now: Column, arrival: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: one micro-batch of both topics into the four live tables below ``path``.

    ``arrival`` names the batch's columns that order messages, such as a topic's timestamp and offset.
    """
    upsert = upsert_batches(f"{path}/trending", run, order=arrival)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            tables = live_tables(batch, now, arrival)
            for name, key in LIVE_KEYS.items():
                insert_if_absent(tables[name], f"{path}/{name}", key, arrival, None, {}, buckets=LIVE_BUCKETS)
            upsert(tables["trending"], batch_id)
        finally:
            batch.unpersist()

    return write


def save_latest_scores(
    path: str, run: str, buckets: int = 64, compact_every: int | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for score records: the latest one of each article in the batch, merged on reading."""
    return upsert_batches(path, run, ["article_id"], ["analysis_timestamp", "record_id"], buckets, compact_every)


def read_latest_scores(spark: SparkSession, path: str, among: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Streaming twin of ``operators.latest.latest_scores``; of the few articles ``among`` alone if these are given."""
    rows = read_upserted(spark, path, ["article_id"], among=among, buckets=buckets)
    return rows.select("article_id", "bias_score", "bias_label")

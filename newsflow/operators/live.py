"""Live messages: tag by kind, normalise to trending rows, route, deduplicate and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions import payload as js
from newsflow.functions.bands import FLAT, risk_level
from newsflow.functions.times import iso_text
from newsflow.operators.latest import first_by
from newsflow.schemas import (
    ANALYZED_TOPIC,
    ARTICLE,
    BURST,
    FORECAST,
    PREDICTIONS_TOPIC,
    TRENDING,
    UNKNOWN_PLATFORM,
)


def _present(document: Column, name: str) -> Column:
    return ~js.is_falsy(js.field(document, name))


def tag_messages(df: DataFrame, topic: str = "topic", document: str = "document") -> DataFrame:
    """Add ``type``: articles by topic, predictions by the id they carry unless they bring a type of their own."""
    value = F.col(document)
    own = js.field(value, "type")
    kept = F.when(_present(value, "type"), F.coalesce(js.text_field(value, "type"), F.to_json(own)))
    by_id = F.when(_present(value, "eventId"), F.lit(BURST)).when(_present(value, "forecastId"), F.lit(FORECAST))
    return df.withColumn(
        "type",
        F.when(F.col(topic) == ANALYZED_TOPIC, F.lit(ARTICLE))
        .when(F.col(topic) == PREDICTIONS_TOPIC, F.coalesce(kept, by_id))
        .otherwise(kept),
    )


def normalize_trending(
    df: DataFrame, now: Column, topic: str = "topic", document: str = "document", keep: Sequence[str] = ()
) -> DataFrame:
    """Predictions that name a topic, as trending rows with defaults; ``now`` stands in for a missing time.

    ``keep`` names columns of the input to carry along.
    """
    value = F.col(document)

    def text(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "string")

    def number(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "double")

    score = number("avgBiasScore")
    return df.filter((F.col(topic) == PREDICTIONS_TOPIC) & _present(value, "topicName")).select(
        F.lit(TRENDING).alias("type"),
        text("topicName").alias("topic_name"),
        F.coalesce(text("platform"), F.lit(UNKNOWN_PLATFORM)).alias("platform"),
        F.coalesce(number("articleCount"), number("predictedVolume"), F.lit(0.0)).alias("volume"),
        score.alias("avg_bias_score"),
        F.coalesce(text("trendDirection"), F.lit(FLAT)).alias("trend_direction"),
        risk_level(score).alias("risk_level"),
        F.coalesce(text("detectionTimestamp"), text("created_at"), iso_text(now)).alias("updated_at"),
        *keep,
    )


def is_valid_message(document: Column) -> Column:
    """A JSON object with a non-empty string ``type``."""
    kind = js.text_field(document, "type")
    return F.coalesce((js.type_of(document) == "object") & (kind != ""), F.lit(False))


def route_messages(df: DataFrame, type_column: str = "type", document: str = "document") -> DataFrame:
    """Add ``route``, null for messages no output takes. A message that has an article id is an article."""
    kind = F.col(type_column)
    has_article_id = js.field(F.col(document), "articleId").isNotNull()
    return df.withColumn(
        "route",
        F.when((kind == ARTICLE) | has_article_id, F.lit(ARTICLE)).when(kind.isin(BURST, FORECAST, TRENDING), kind),
    )


def routed(df: DataFrame, route: str) -> DataFrame:
    return df.filter(F.col("route") == route)


def dedup_first(df: DataFrame, key: str, arrival: Sequence[str | Column]) -> DataFrame:
    """One row per id, the first to arrive."""
    return first_by(df, [key], arrival)


def upsert_latest(
    df: DataFrame,
    keys: Sequence[str] = ("topic_name", "platform"),
    order: Sequence[str | Column] = ("updated_at",),
    cap: int | None = None,
) -> DataFrame:
    """One row per key, the last to arrive. With ``cap``, the keys that appeared most recently.

    End ``order`` with a unique column where equal times occur. New keys go to the front of the list and known keys keep their place, so the cap ranks by first
    appearance.
    """
    arrival = F.struct(*order)
    merged = df.groupBy(*keys).agg(
        F.max_by(F.struct(*df.columns), arrival).alias("_row"), F.min(arrival).alias("_first")
    )
    if cap is not None:
        merged = merged.orderBy(F.col("_first").desc(), *keys).limit(cap)
    return merged.select("_row.*")

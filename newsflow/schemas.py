"""Record layouts. Messages travel as JSON text, tables as typed columns."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"

# Topic names and message type tags.
RAW_TOPIC, ANALYZED_TOPIC, PREDICTIONS_TOPIC = "raw-news", "analyzed-news", "predictions"
ARTICLE, BURST, FORECAST, TRENDING = "article", "burst_event", "trend_forecast", "trending_topic"

UNKNOWN_TOPIC, UNKNOWN_PLATFORM = "unknown", "Unknown"

RAW_FIELDS = ("articleId", "sourceUrl", "title", "body", "sourceName", "publishedAt", "schemaVersion")


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_TEXT, _FLOAT, _LONG, _INT, _FLAG = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_TIME = T.TimestampType()

RAW_MESSAGE = _fields(*((name, _TEXT) for name in RAW_FIELDS))

ANALYZED_MESSAGE = T.StructType(
    RAW_MESSAGE.fields
    + _fields(
        ("biasScore", _FLOAT), ("biasLabel", _TEXT), ("analysisTimestamp", _TEXT), ("errorFlag", _FLAG)
    ).fields
)

ARTICLES = _fields(
    ("article_id", _TEXT),
    ("source_url", _TEXT),
    ("title", _TEXT),
    ("body", _TEXT),
    ("source_name", _TEXT),
    ("published_at", _TIME),
    ("schema_version", _TEXT),
    ("ingested_at", _TIME),
)

BIAS_RECORDS = _fields(
    ("record_id", _TEXT),
    ("article_id", _TEXT),
    ("bias_score", _FLOAT),
    ("bias_label", _TEXT),
    ("analysis_timestamp", _TIME),
    ("error_flag", _FLAG),
)

BURST_EVENTS = _fields(
    ("event_id", _TEXT),
    ("topic_name", _TEXT),
    ("platform", _TEXT),
    ("article_count", _LONG),
    ("avg_bias_score", _FLOAT),
    ("trend_direction", _TEXT),
    ("window_start", _TIME),
    ("window_end", _TIME),
    ("detection_timestamp", _TIME),
)

TREND_FORECASTS = _fields(
    ("forecast_id", _TEXT),
    ("topic_name", _TEXT),
    ("platform", _TEXT),
    ("predicted_volume", _FLOAT),
    ("confidence_score", _FLOAT),
    ("avg_bias_score", _FLOAT),
    ("trend_direction", _TEXT),
    ("forecast_horizon", _TIME),
    ("created_at", _TIME),
)

DELIVERY_LOG = _fields(
    ("log_id", _TEXT), ("session_id", _TEXT), ("event_type", _TEXT), ("payload", _TEXT), ("delivered_at", _TIME)
)

OFFSETS = _fields(("group_id", _TEXT), ("topic", _TEXT), ("partition", _INT), ("committed", _LONG))
END_OFFSETS = _fields(("topic", _TEXT), ("partition", _INT), ("end_offset", _LONG))

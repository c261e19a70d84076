"""Message streams in and out. The same functions serve topics on a broker and files as stand-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter

from newsflow.functions.times import iso_text
from newsflow.schemas import ANALYZED_MESSAGE, ANALYZED_TOPIC, PREDICTIONS_TOPIC, RAW_FIELDS, RAW_TOPIC

# Nulls are part of the message contract; Spark would leave them out.
_WITH_NULLS = {"ignoreNullFields": "false"}


def topic_options(brokers: str, topics: Sequence[str], starting: str = "earliest") -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
    }


def read_topics(spark: SparkSession, brokers: str, topics: Sequence[str], starting: str = "earliest") -> DataFrame:
    """Stream of (key, value, topic, partition, offset, timestamp). Progress lives in the query's checkpoint."""
    return spark.readStream.format("kafka").options(**topic_options(brokers, topics, starting)).load()


def read_raw(spark: SparkSession, brokers: str) -> DataFrame:
    return read_topics(spark, brokers, [RAW_TOPIC])


def read_analyzed(spark: SparkSession, brokers: str) -> DataFrame:
    return read_topics(spark, brokers, [ANALYZED_TOPIC])


def read_live(spark: SparkSession, brokers: str) -> DataFrame:
    """Both outgoing topics from now on; the ``topic`` column tells them apart."""
    return read_topics(spark, brokers, [PREDICTIONS_TOPIC, ANALYZED_TOPIC], "latest")


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", glob: str | None = None, **options: str
) -> DataFrame:
    """Files as a stream, new files being new messages."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _json(columns: Sequence[str | Column]) -> Column:
    return F.to_json(F.struct(*columns), _WITH_NULLS).alias("value")


def raw_payloads(raw: DataFrame) -> DataFrame:
    """Raw messages keyed by article id, so all versions of an article share a partition."""
    return raw.select(F.col("articleId").alias("key"), _json(RAW_FIELDS))


def analyzed_payloads(analyzed: DataFrame) -> DataFrame:
    return analyzed.select(_json(ANALYZED_MESSAGE.names))


def burst_payloads(bursts: DataFrame) -> DataFrame:
    return bursts.select(
        _json(
            [
                F.col("event_id").alias("eventId"),
                F.col("topic_name").alias("topicName"),
                "platform",
                F.col("article_count").alias("articleCount"),
                F.col("avg_bias_score").alias("avgBiasScore"),
                F.col("trend_direction").alias("trendDirection"),
                iso_text(F.col("window_start")).alias("windowStart"),
                iso_text(F.col("window_end")).alias("windowEnd"),
                iso_text(F.col("detection_timestamp")).alias("detectionTimestamp"),
            ]
        )
    )


def forecast_payloads(forecasts: DataFrame) -> DataFrame:
    return forecasts.select(
        _json(
            [
                F.col("forecast_id").alias("forecastId"),
                F.col("topic_name").alias("topicName"),
                "platform",
                F.col("predicted_volume").cast("bigint").alias("predictedVolume"),
                F.col("confidence_score").alias("confidenceScore"),
                F.col("avg_bias_score").alias("avgBiasScore"),
                F.col("trend_direction").alias("trendDirection"),
                iso_text(F.col("forecast_horizon")).alias("forecastHorizon"),
            ]
        )
    )


def prediction_payloads(bursts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Both kinds mixed in one topic."""
    return burst_payloads(bursts).unionByName(forecast_payloads(forecasts))


def write_topic(payloads: DataFrame, brokers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a payload stream to a topic, at least once, acknowledged by all replicas."""
    return (
        payloads.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )

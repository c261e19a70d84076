"""The engine's inputs, derived from the given tables. ``plans.oracle`` states the same views in SQL.

Timestamps stay zone-less here from scan to result; streams cast them because watermarks need instants.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.scoring import keyword_score, score_label
from newsflow.operators.scoring import score_keywords
from newsflow.operators.windows import burst_detection, trend_forecast
from newsflow.schemas import ANALYZED_TOPIC, PREDICTIONS_TOPIC
from newsflow.sources.session import fresh_dir, prepare
from newsflow.sources.streams import burst_payloads, forecast_payloads

DAY_MS = 86_400_000
THRESHOLD = 24

# A second word list: fragments that are frequent in the given documents.
SECOND_KEYWORDS = ("the", "and", "ing", "tion", "chein", "este", "ent", "que", "eran", "sch")

# Arrival of events in waves: those with an id divisible by LATE_EVERY come LATE_DAYS late.
WAVE_DAYS, LATE_DAYS, LATE_EVERY = 11, 3, 50

# Number of message shapes made from the documents, one per value of doc_id modulo the count.
RAW_SHAPES, PAYLOAD_SHAPES, MESSAGE_SHAPES = 13, 8, 6


def analyzed_of(events: DataFrame) -> DataFrame:
    """Each event as a scored message: topic = event type, platform = one of four feeds.

    The score saturates with the value, so means have no short decimal form that could sit on a rounding edge.
    """
    step = 1 + F.length("event_type") % 4
    failed = F.col("value") < 5
    return events.select(
        F.col("event_id").cast("string").alias("articleId"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string")).alias("sourceName"),
        F.col("ts").alias("publishedAt"),
        F.when(~failed, 1 - F.exp(-F.col("value") / (step * step * 25))).alias("biasScore"),
        failed.alias("errorFlag"),
    )


def articles_of(documents: DataFrame) -> DataFrame:
    """Each document as an article: its first line is the title, its length decides the time."""
    published = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("n_chars").cast("int"))
    return documents.select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.concat(F.lit("https://example.org/"), "source", F.lit("/"), "doc_id").alias("source_url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.col("source").alias("source_name"),
        published.alias("published_at"),
        F.lit("1.0").alias("schema_version"),
        (published + F.expr("INTERVAL 30 MINUTES")).alias("ingested_at"),
    )


def _shape(count: int) -> Column:
    return F.col("doc_id") % count


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        prepare(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def analyzed(self) -> DataFrame:
        return analyzed_of(self.table("events"))

    @property
    def analyzed_stream(self) -> DataFrame:
        events = (
            self.spark.readStream.schema(self.table("events").schema)
            .option("pathGlobFilter", "events.parquet")
            .parquet(self.sf_dir)
        )
        return analyzed_of(events.withColumn("ts", F.col("ts").cast("timestamp")))

    @cached_property
    def waves(self) -> list[DataFrame]:
        """The events as they arrive, a wave for each eleven days; some come three days late."""
        late = F.when(F.col("event_id") % LATE_EVERY == 0, F.lit(LATE_DAYS)).otherwise(F.lit(0))
        day = F.datediff(F.col("ts") + F.make_dt_interval(days=late), F.lit("2024-01-01").cast("date"))
        events = self.table("events").withColumn("_wave", F.floor(day / WAVE_DAYS))
        last = events.select(F.max("_wave")).scalar()
        number = events.select(last).first()[0]
        return [events.filter(F.col("_wave") == w).drop("_wave") for w in range(number + 1)]

    @property
    def end_clock(self) -> DataFrame:
        """One time two days past the last event, as a stream: the end of this bounded input."""
        place = fresh_dir(self.spark, "clock")
        last = self.table("events").agg(F.max("ts").cast("timestamp").alias("last"))
        last.select((F.col("last") + F.expr("INTERVAL 2 DAYS")).alias("publishedAt")).write.parquet(place)
        return self.spark.readStream.schema("publishedAt timestamp").parquet(place)

    @cached_property
    def deliveries(self) -> DataFrame:
        """Analyzed messages delivered at least once: high values come again an hour later, marked as repeats."""
        once = self.analyzed.withColumn("arrived_at", F.col("publishedAt"))
        again = once.filter(F.col("biasScore") > 0.5).select(
            "articleId",
            F.concat("title", F.lit(" again")).alias("title"),
            "sourceName",
            "publishedAt",
            "biasScore",
            "errorFlag",
            (F.col("arrived_at") + F.expr("INTERVAL 1 HOUR")).alias("arrived_at"),
        )
        return once.unionByName(again)

    @cached_property
    def bursts(self) -> DataFrame:
        return burst_detection(self.analyzed, THRESHOLD, DAY_MS)

    @cached_property
    def forecasts(self) -> DataFrame:
        return trend_forecast(self.analyzed, THRESHOLD, DAY_MS)

    @cached_property
    def articles(self) -> DataFrame:
        return articles_of(self.documents)

    def _records(self, run: int, score: Column, after: Column) -> DataFrame:
        scored = self.articles.select(
            F.concat("article_id", F.lit(f"-{run}")).alias("record_id"),
            "article_id",
            score.alias("_score"),
            (F.col("published_at") + after).alias("analysis_timestamp"),
            F.contains(F.col("body"), F.lit("@")).alias("error_flag"),
        ).withColumn("bias_score", F.when(~F.col("error_flag"), F.col("_score")))
        return scored.select(
            "record_id",
            "article_id",
            "bias_score",
            score_label(F.col("bias_score")).alias("bias_label"),
            "analysis_timestamp",
            "error_flag",
        )

    @cached_property
    def bias_records(self) -> DataFrame:
        """Two runs over all documents, the second with other words; it came later for every second document. Documents with
        an at sign could not be scored."""
        even = F.col("article_id").cast("bigint") % 2 == 0
        later = F.when(even, F.make_dt_interval(days=F.lit(1))).otherwise(F.make_dt_interval(mins=F.lit(30)))
        second = self._records(2, keyword_score(F.col("body"), SECOND_KEYWORDS), later)
        return self._records(1, keyword_score(F.col("body")), F.make_dt_interval(hours=F.lit(1))).unionByName(second)

    @cached_property
    def raw_json(self) -> DataFrame:
        """Each document as the JSON a feed would send, sound or with one of twelve defects."""
        shape = _shape(RAW_SHAPES)
        pad = F.when(shape == 11, F.lit(" \t\u00a0 ")).otherwise(F.lit(""))

        def padded(value: Column) -> Column:
            return F.concat(pad, value, pad)

        message = F.to_json(
            F.struct(
                F.when(~shape.isin(1, 2), padded(F.col("doc_id").cast("string"))).alias("articleId"),
                padded(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).alias("sourceUrl"),
                F.when(shape == 4, F.lit(" \t\u00a0")).when(shape != 3, padded(F.col("lang"))).alias("title"),
                F.when(shape == 8, F.lit("")).when(shape != 9, F.col("text")).alias("body"),
                F.when(shape != 5, padded(F.col("source"))).alias("sourceName"),
                F.when(shape == 6, F.lit("2024-01-15"))
                .when(shape == 7, F.lit("2024-13-15T10:30:00Z"))
                .otherwise(padded(F.lit("2024-01-15T10:30:00.000Z")))
                .alias("publishedAt"),
            )
        )
        rest = F.expr("substring(_message, 2)")
        return self.documents.select("doc_id", message.alias("_message")).select(
            "doc_id",
            F.when(shape == 2, F.concat(F.lit('{"articleId":null,'), rest))
            .when(shape == 3, F.concat(F.lit('{"title":5,'), rest))
            .when(shape == 10, F.expr("substring(_message, 1, length(_message) - 1)"))
            .when(shape == 12, F.concat("_message", F.lit(" trailing")))
            .otherwise(F.col("_message"))
            .alias("value"),
        )

    @cached_property
    def payloads(self) -> DataFrame:
        """Each document inside one of eight kinds of payload, from a plain list to text that is no JSON."""
        shape = _shape(PAYLOAD_SHAPES)
        item = F.to_json(F.struct(F.col("lang").alias("title"), F.col("text").alias("body")))
        return self.documents.select(
            "doc_id",
            F.when(shape == 0, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
            .when(shape == 1, F.concat(F.lit('{"articles":['), item, F.lit("]}")))
            .when(shape == 2, item)
            .when(shape == 3, F.lit("[]"))
            .when(shape == 4, F.lit('{"articles":5}'))
            .when(shape == 5, F.col("text"))
            .when(shape == 6, F.lit(""))
            .otherwise(F.concat(F.lit('{"articles":['), item, F.lit(",5]}")))
            .alias("value"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        """What the live side receives: analyzed articles, bursts, and forecasts sound or with a defect."""
        sound = forecast_payloads(self.forecasts.withColumn("avg_bias_score", F.round("avg_bias_score", 10)))
        shape = F.get_json_object("value", "$.predictedVolume").cast("bigint") % MESSAGE_SHAPES
        changed = sound.select(
            F.concat(F.lit("f-"), F.get_json_object("value", "$.forecastId")).alias("message_id"),
            F.lit(PREDICTIONS_TOPIC).alias("topic"),
            F.when(shape == 0, F.regexp_replace("value", '"forecastId":"[^"]*",', ""))
            .when(shape == 1, F.concat(F.lit('{"type":"custom",'), F.expr("substring(value, 2)")))
            .when(shape == 2, F.expr("substring(value, 1, length(value) - 1)"))
            .when(shape == 3, F.regexp_replace("value", '"platform":"[^"]*"', '"platform":null'))
            .otherwise(F.col("value"))
            .alias("value"),
        )
        bursts = burst_payloads(self.bursts.withColumn("avg_bias_score", F.round("avg_bias_score", 10))).select(
            F.concat(F.lit("b-"), F.get_json_object("value", "$.eventId")).alias("message_id"),
            F.lit(PREDICTIONS_TOPIC).alias("topic"),
            "value",
        )
        articles = self.analyzed.select(
            F.concat(F.lit("a-"), "articleId").alias("message_id"),
            F.lit(ANALYZED_TOPIC).alias("topic"),
            F.to_json(F.struct("articleId", "title", "sourceName")).alias("value"),
        )
        return articles.unionByName(bursts).unionByName(changed)

    @cached_property
    def raw_messages(self) -> DataFrame:
        """Documents as sound raw messages."""
        return self.articles.select(
            F.col("article_id").alias("articleId"),
            F.col("source_url").alias("sourceUrl"),
            "title",
            "body",
            F.col("source_name").alias("sourceName"),
            F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
            F.col("schema_version").alias("schemaVersion"),
        )

    @cached_property
    def scored_messages(self) -> DataFrame:
        scored = score_keywords(self.raw_messages, "body", SECOND_KEYWORDS)
        return scored.withColumn("analysisTimestamp", F.lit("2024-06-01T00:00:00Z"))

    def offsets(self) -> tuple[DataFrame, DataFrame]:
        """Offsets of a topic per event type with three partitions; each group has read up to its own time."""
        located = self.table("events").select(
            F.col("event_type").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), "ts"
        )
        ends = located.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("end_offset"))

        def read_up_to(group: str, time: str) -> DataFrame:
            return located.groupBy("topic", "partition").agg(
                F.count_if(F.col("ts") <= F.lit(time).cast("timestamp_ntz")).alias("committed")
            ).select(F.lit(group).alias("group_id"), "topic", "partition", "committed")

        return read_up_to("live", "2024-01-30 12:00:00").unionByName(read_up_to("nightly", "2024-01-25 00:00:00")), ends

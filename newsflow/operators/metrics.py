"""Dashboard figures: heatmap, key figures, risk shares, velocity and keyword salience."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow.functions.bands import COLOUR_BANDS, RISK_LEVELS, colour_band
from newsflow.operators.joins import join_group_totals
from newsflow.schemas import UNKNOWN_PLATFORM

# Trailing ranges of the velocity chart and the length of its buckets.
RANGES = {"1H": "INTERVAL 1 HOUR", "24H": "INTERVAL 24 HOURS", "7D": "INTERVAL 7 DAYS", "30D": "INTERVAL 30 DAYS"}
BUCKET = "4 hours"

# Keywords that one pass over the texts looks for.
KEYWORDS_AT_ONCE = 50_000


def heatmap(scored_articles: DataFrame) -> DataFrame:
    """Articles per source and colour band, one row per source."""
    band = colour_band(F.col("bias_score"))
    return scored_articles.groupBy(F.coalesce("source_name", F.lit(UNKNOWN_PLATFORM)).alias("source_name")).agg(
        F.count(F.lit(1)).alias("articles"), *(F.count_if(band == b).alias(f"{b}_articles") for b in COLOUR_BANDS)
    )


def articles_by_source(scored_articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Every article with its band and the size of its source's group.

    Members stay rows. Group sizes are counted with map-side combine and joined back with large sources cut
    into shares, so a source that holds a third of all articles never meets in one task.
    """
    banded = scored_articles.withColumns(
        {
            "source_name": F.coalesce("source_name", F.lit(UNKNOWN_PLATFORM)),
            "colour_band": colour_band(F.col("bias_score")),
        }
    )
    sizes = banded.groupBy("source_name").agg(F.count(F.lit(1)).alias("source_articles"))
    return join_group_totals(banded, sizes, ["source_name"], "source_articles", F.col(key))


def kpi_summary(trending: DataFrame) -> DataFrame:
    """Topics, critical topics, platforms and the mean score, over the trending table."""
    return trending.agg(
        F.count(F.lit(1)).alias("total_topics"),
        F.count_if(F.col("risk_level") == "critical").alias("critical_topics"),
        F.count_distinct("platform").alias("active_platforms"),
        F.avg("avg_bias_score").alias("mean_bias_score"),
    )


def risk_distribution(trending: DataFrame) -> DataFrame:
    """Topics per risk level and their share in percent; levels without topics show zero."""
    counted = trending.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("risk_level") == r).alias(r) for r in RISK_LEVELS)
    )
    levels = F.array(*(F.struct(F.lit(r).alias("risk_level"), F.col(r).alias("topics")) for r in RISK_LEVELS))
    return counted.select("total", F.inline(levels)).select(
        "risk_level",
        "topics",
        F.when(F.col("total") > 0, F.col("topics") * 100.0 / F.col("total")).otherwise(F.lit(0.0)).alias("percent"),
    )


def velocity_series(
    analyzed: DataFrame, trailing: str = "7D", bucket: str = BUCKET, ts: str = "publishedAt"
) -> DataFrame:
    """Mean score per bucket over the range that ends with the newest row; the highest bucket is the peak."""
    newest = analyzed.select(F.max(ts).alias("newest")).scalar()
    series = (
        analyzed.filter(F.col(ts) > newest - F.expr(RANGES[trailing]))
        .groupBy(F.window(ts, bucket).alias("span"))
        .agg(F.avg("biasScore").alias("value"), F.count(F.lit(1)).alias("articles"))
        .select(F.col("span.start").alias("bucket_start"), "value", "articles")
    )
    # The range holds few buckets, at most its length over the bucket's, so one task may look at all of them.
    highest = F.max("value").over(W.partitionBy(F.lit(0)))
    return series.withColumn("is_peak", F.coalesce(F.col("value") == highest, F.lit(False)))


def _mentions(words: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, per task, the texts of either period that hold each word: one walk over a text finds all words in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            automaton.add_word(word, number)
        automaton.make_automaton()
        counts = ([0] * len(words), [0] * len(words))
        for batch in batches:
            for text, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of_period = counts[0 if now else 1]
                for number in {number for _, number in automaton.iter(text)}:
                    of_period[number] += 1
        seen = [i for i, both in enumerate(zip(*counts, strict=True)) if any(both)]
        columns = [pa.array([words[i] for i in seen], pa.string()), *(pa.array([c[i] for i in seen], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["_word", "current", "previous"])

    return count


def keyword_salience(
    articles: DataFrame,
    keywords: Sequence[str] | DataFrame,
    period: str = "INTERVAL 7 DAYS",
    text: str = "body",
    ts: str = "published_at",
    at_once: int = KEYWORDS_AT_ONCE,
) -> DataFrame:
    """Articles that mention each keyword in the last period against the one before, ranked by change.

    ``keywords`` is a list or a table with one column of texts, of any length. The words travel to the tasks, ``at_once`` of
    them in one pass over the texts and further ones in further passes, so neither a plan nor a task grows with their number.
    An empty keyword is in every text. Change is null for a keyword the earlier period does not have.
    """
    spark = articles.sparkSession
    given = keywords if isinstance(keywords, DataFrame) else spark.createDataFrame([(k,) for k in keywords], "keyword string")
    listed = given.select(F.col(given.columns[0]).alias("keyword")).filter("keyword is not null").distinct()
    listed = listed.withColumn("_word", F.lower("keyword"))
    newest = articles.select(F.max(ts).alias("newest")).scalar()
    span = F.expr(period)
    recent = articles.filter(F.col(ts) > newest - span - span).select(
        F.lower(F.col(text)).alias("_text"), (F.col(ts) > newest - span).alias("_now")
    )
    recent = recent.filter("_text is not null")
    words, passes = listed.select("_word").distinct(), []
    number = max(1, -(-words.count() // at_once))
    for turn in range(number):
        part = words.filter((F.pmod(F.xxhash64("_word"), F.lit(number)) == turn) & (F.col("_word") != ""))
        names = sorted(r["_word"] for r in part.collect())  # about ``at_once`` words
        if names:
            passes.append(recent.mapInArrow(_mentions(names), "_word string, current long, previous long"))
    everywhere = recent.agg(F.lit("").alias("_word"), F.count_if("_now").alias("current"), F.count_if(~F.col("_now")).alias("previous"))
    found = reduce(DataFrame.unionByName, passes, everywhere)
    sums = found.groupBy("_word").agg(F.sum("current").alias("current"), F.sum("previous").alias("previous"))
    counted = listed.join(sums, "_word", "left").select("keyword", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("current", "previous")))
    change = F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) * 100.0 / F.col("previous"))
    ranked = F.rank().over(W.orderBy(F.col("change").desc_nulls_last(), F.col("keyword")))
    return counted.withColumn("change", change).withColumn("rank", ranked)

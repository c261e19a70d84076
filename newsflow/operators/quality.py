"""Table constraints as a report of violations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions.bands import DIRECTIONS


def _null(*names: str) -> dict[str, Column]:
    return {f"{name} not null": F.col(name).isNull() for name in names}


def _outside_unit(name: str) -> dict[str, Column]:
    return {f"{name} in [0,1]": F.col(name).isNotNull() & ~F.col(name).between(0.0, 1.0)}


def _direction() -> dict[str, Column]:
    return {"trend_direction known": ~F.col("trend_direction").isin(*DIRECTIONS)}


# Per table: primary key, and the condition under which a row breaks each rule.
RULES: dict[str, tuple[str, Callable[[], dict[str, Column]]]] = {
    "articles": (
        "article_id",
        lambda: _null("article_id", "source_url", "title", "body", "source_name", "published_at", "schema_version", "ingested_at"),
    ),
    "bias_records": (
        "record_id",
        lambda: _null("record_id", "article_id", "analysis_timestamp", "error_flag") | _outside_unit("bias_score"),
    ),
    "burst_events": (
        "event_id",
        lambda: _null("event_id", "topic_name", "platform", "article_count", "trend_direction", "window_start", "window_end", "detection_timestamp")
        | _outside_unit("avg_bias_score")
        | _direction()
        | {
            "article_count positive": F.col("article_count") <= 0,
            "window_end after window_start": F.col("window_end") <= F.col("window_start"),
        },
    ),
    "trend_forecasts": (
        "forecast_id",
        lambda: _null(
            "forecast_id", "topic_name", "platform", "predicted_volume", "confidence_score", "trend_direction",
            "forecast_horizon", "created_at",
        )
        | _outside_unit("confidence_score")
        | _outside_unit("avg_bias_score")
        | _direction()
        | {"predicted_volume not negative": F.col("predicted_volume") < 0},
    ),
}


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """Every rule of one table, its key included, counted in one pass: (table_name, rule, violations).

    Rows are counted per key, and the counts of broken rules go along.
    """
    key, rules = RULES[table][0], RULES[table][1]()
    marks = [f"r{i}" for i in range(len(rules))]
    per_key = df.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(broken).alias(mark) for mark, broken in zip(marks, rules.values(), strict=True))
    )
    counted = per_key.agg(
        *(F.coalesce(F.sum(mark), F.lit(0)).alias(mark) for mark in marks), F.count_if(F.col("n") > 1).alias("repeated")
    )
    named = dict(zip(rules, marks, strict=True)) | {f"{key} unique": "repeated"}
    listed = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(mark).alias("violations")) for rule, mark in named.items()))
    return counted.select(F.lit(table).alias("table_name"), F.inline(listed))


def reference_violations(bias_records: DataFrame, articles: DataFrame) -> DataFrame:
    """Records without their article, counted per id before the join so that no id is hot in it."""
    per_id = bias_records.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    lost = per_id.join(articles.select("article_id"), "article_id", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit("bias_records").alias("table_name"), F.lit("article_id references articles").alias("rule"), "violations"
    )


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """All rules of the given tables: (table_name, rule, violations)."""
    parts = [table_violations(df, name) for name, df in tables.items()]
    if {"articles", "bias_records"} <= tables.keys():
        parts.append(reference_violations(tables["bias_records"], tables["articles"]))
    return reduce(DataFrame.unionByName, parts)

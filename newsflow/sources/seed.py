"""Seed rows: five articles with a score record, a burst and a forecast each, at times relative to a given now."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from newsflow.functions.scoring import BIASED, NEUTRAL
from newsflow.schemas import ARTICLES, BIAS_RECORDS, BURST_EVENTS, SCHEMA_VERSION, TREND_FORECASTS

# One line per seed topic. Platform, burst count, forecast volume, confidence, score, direction, label.
SEED_TOPICS = (
    ("Energy Policy Reform", "NewsAPI", 12, 14.0, 0.72, 0.38, "↑", "elevated"),
    ("Regional Conflict Escalation", "SocialStream", 27, 31.0, 0.91, 0.74, "↑", BIASED),
    ("Tech Layoff Rumors", "NewsAPI", 8, 8.0, 0.48, 0.21, "→", NEUTRAL),
    ("Climate Infrastructure Investment", "NewsAPI", 19, 22.0, 0.85, 0.15, "↑", NEUTRAL),
    ("Cyber Threat Alert", "SocialStream", 34, 40.0, 0.95, 0.82, "↑", BIASED),
)

# Address and headline of the seed articles, in the order of the topics.
SEED_ARTICLES = (
    ("energy-policy-reform", "Energy Policy Reform Gains Momentum Across South Asia"),
    ("regional-conflict", "Regional Conflict Escalation Raises Diplomatic Concerns"),
    ("tech-layoffs", "Tech Sector Layoff Rumors Spark Market Volatility"),
    ("climate-infrastructure", "Climate Infrastructure Investment Reaches Record High"),
    ("cyber-threat-alert", "Cyber Threat Actors Target Critical Infrastructure Networks"),
)


def _id(kind: str, number: int) -> str:
    return f"{kind}1000000-0000-0000-0000-{number:012d}"


def seed_tables(spark: SparkSession, now: datetime) -> dict[str, DataFrame]:
    """The four seed tables. Ids are fixed, so loading them through insert-if-absent twice adds nothing.

    Article bodies repeat the headline; nothing depends on them. A ``now`` without a zone is UTC.
    """
    now = now.replace(tzinfo=UTC) if now.tzinfo is None else now
    articles, records, bursts, forecasts = [], [], [], []
    for n, ((topic, platform, count, volume, confidence, score, mark, label), (slug, title)) in enumerate(
        zip(SEED_TOPICS, SEED_ARTICLES, strict=True), start=1
    ):
        published = now - timedelta(minutes=12 - 2 * n)
        articles.append(
            (_id("a", n), f"https://example.com/{slug}", title, title, platform, published, SCHEMA_VERSION, now)
        )
        records.append((_id("b", n), _id("a", n), score, label, now, False))
        start, end = now - timedelta(minutes=15), now - timedelta(minutes=5)
        bursts.append((_id("e", n), topic, platform, count, score, mark, start, end, end))
        forecasts.append(
            (_id("f", n), topic, platform, volume, confidence, score, mark, now + timedelta(hours=1), now)
        )
    return {
        "articles": spark.createDataFrame(articles, ARTICLES),
        "bias_records": spark.createDataFrame(records, BIAS_RECORDS),
        "burst_events": spark.createDataFrame(bursts, BURST_EVENTS),
        "trend_forecasts": spark.createDataFrame(forecasts, TREND_FORECASTS),
    }

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators import latest, metrics, pages, predictions, trending
from newsflow.operators.joins import join_group_totals
from newsflow.sources.seed import SEED_TOPICS, seed_tables

T0 = datetime(2024, 1, 1)
BURSTS = (
    "event_id string, topic_name string, platform string, article_count bigint, avg_bias_score double,"
    " trend_direction string, window_start timestamp_ntz, window_end timestamp_ntz, detection_timestamp timestamp_ntz"
)
FORECASTS = (
    "forecast_id string, topic_name string, platform string, predicted_volume double, confidence_score double,"
    " avg_bias_score double, trend_direction string, forecast_horizon timestamp_ntz, created_at timestamp_ntz"
)
RECORDS = "record_id string, article_id string, bias_score double, bias_label string, analysis_timestamp timestamp_ntz, error_flag boolean"


def _at(minutes):
    return T0 + timedelta(minutes=minutes)


def _burst(ident, topic, minutes, count=5, score=0.5, platform="p"):
    return ident, topic, platform, count, score, "→", _at(minutes - 1), _at(minutes), _at(minutes)


def _forecast(ident, topic, minutes, volume=5.0, score=0.5, platform="p"):
    return ident, topic, platform, volume, 0.5, score, "→", _at(minutes + 60), _at(minutes)


def test_trending_prefers_bursts_and_breaks_ties_by_id(rows):
    bursts = rows([_burst("b1", "both", 1, 7), _burst("b2", "tied", 2, 8), _burst("b3", "tied", 2, 9), _burst("b0", "tied", 1, 1)], BURSTS)
    forecasts = rows(
        [
            _forecast("f1", "both", 9),
            _forecast("f2", "only", 1, 2.5, 0.7),
            _forecast("f3", "only", 0, 99.0),
            _forecast("f4", "even", 1, 3.5, None),
            _forecast("f5", "both", 1, platform="q"),
        ],
        FORECASTS,
    )
    found = trending.trending_topics(bursts, forecasts).collect()
    assert {(r.topic_name, r.platform): (r.volume, r.risk_level) for r in found} == {
        ("both", "p"): (7, "elevated"),
        ("both", "q"): (5, "elevated"),
        ("tied", "p"): (9, "elevated"),
        ("only", "p"): (2, "critical"),
        ("even", "p"): (4, "stable"),
    }


def test_seed_trending_is_the_five_bursts(spark):
    tables = seed_tables(spark, T0)
    found = trending.trending_topics(tables["burst_events"], tables["trend_forecasts"]).collect()
    assert {(r.topic_name, r.volume) for r in found} == {(t[0], t[2]) for t in SEED_TOPICS}
    assert {r.topic_name: r.risk_level for r in found} == {
        "Energy Policy Reform": "elevated",
        "Regional Conflict Escalation": "critical",
        "Tech Layoff Rumors": "stable",
        "Climate Infrastructure Investment": "stable",
        "Cyber Threat Alert": "critical",
    }


def test_latest_score_cases(rows):
    articles = rows([("none",), ("one",), ("tied",), ("failed",)], "article_id string")
    records = rows(
        [
            ("r1", "one", 0.1, "neutral", _at(1), False),
            ("r2", "tied", 0.2, "neutral", _at(2), False),
            ("r3", "tied", 0.3, "neutral", _at(2), False),
            ("r4", "failed", 0.9, "biased", _at(1), False),
            ("r5", "failed", None, "unknown", _at(5), True),
            ("r6", "stranger", 0.5, "biased", _at(1), False),
        ],
        RECORDS,
    )
    found = latest.with_latest_score(articles, records).collect()
    assert {r.article_id: (r.bias_score, r.bias_label) for r in found} == {
        "none": (None, None), "one": (0.1, "neutral"), "tied": (0.3, "neutral"), "failed": (None, "unknown"),
    }
    assert [r.record_id for r in latest.orphan_records(records, articles).collect()] == ["r6"]
    assert latest.cascade_records(records, articles).count() == 5


def test_latest_score_equals_lateral_join(spark, rows):
    articles = rows([(str(i),) for i in range(20)], "article_id string")
    records = rows(
        [(f"r{i}", str(i % 13), i / 100, "neutral", _at(i % 5), False) for i in range(60)], RECORDS
    )
    articles.createOrReplaceTempView("lateral_articles")
    records.createOrReplaceTempView("lateral_records")
    by_sql = spark.sql(
        """
        SELECT a.article_id, r.bias_score, r.bias_label
        FROM lateral_articles AS a LEFT JOIN LATERAL (
            SELECT bias_score, bias_label FROM lateral_records AS b WHERE b.article_id = a.article_id
            ORDER BY analysis_timestamp DESC, record_id DESC LIMIT 1
        ) AS r
        """
    )
    ours = latest.with_latest_score(articles, records)
    assert {tuple(r) for r in ours.collect()} == {tuple(r) for r in by_sql.collect()}
    assert ours.count() == 20


def test_union_has_thirteen_typed_columns(rows):
    union = predictions.predictions_union(rows([_burst("b", "t", 1)], BURSTS), rows([_forecast("f", "t", 1)], FORECASTS))
    assert len(union.columns) == 13
    by_type = {r.type: r for r in union.collect()}
    assert by_type["burst_event"].predicted_volume is None and by_type["burst_event"].article_count == 5
    assert by_type["trend_forecast"].article_count is None
    assert by_type["trend_forecast"].forecast_horizon == "2024-01-01T01:01:00Z"


def test_client_defaults(rows):
    now = F.lit(T0)
    articles = rows([(None, None, None, None, 0.4)], "article_id string, title string, source_name string, published_at timestamp_ntz, bias_score double")
    assert tuple(predictions.article_rows(articles, now).first()) == ("", "Untitled", "Unknown", "2024-01-01T00:00:00Z", 0.4)
    union = rows(
        [("burst_event",), ("trend_forecast",)], "type string"
    ).selectExpr(
        "type", "cast(null as string) id", "cast(null as string) topic_name", "cast(null as bigint) article_count",
        "cast(null as timestamp_ntz) window_start", "cast(null as timestamp_ntz) window_end",
        "cast(null as timestamp_ntz) created_at", "cast(null as double) predicted_volume",
        "cast(null as double) confidence_score", "cast(null as string) forecast_horizon",
    )
    assert tuple(predictions.burst_rows(union, now).first()) == ("", "", 0, "", "", "2024-01-01T00:00:00Z")
    assert tuple(predictions.forecast_rows(union).first()) == ("", "", 0.0, 0.0, "")


@pytest.mark.parametrize(
    ("page", "size", "clamped"),
    [(None, None, (1, 20)), (0, 0, (1, 1)), (-3, 101, (1, 100)), (2, 50, (2, 50))],
)
def test_clamp(page, size, clamped):
    assert pages.clamp(page, size) == clamped


@pytest.fixture
def dated(rows):
    # Ties on purpose: three ids per time.
    return rows([(f"{i:04d}", _at(i // 3)) for i in range(500)], "id string, at timestamp_ntz").repartition(7)


def _expected(offset, size):
    ranked = sorted(range(500), key=lambda i: (-(i // 3), f"{i:04d}"))
    return [f"{i:04d}" for i in ranked[offset : offset + size]]


@pytest.mark.parametrize("cut", [pages.page_of, pages.page_by_position])
@pytest.mark.parametrize(("page", "size"), [(1, 20), (3, 100), (5, 100), (6, 100), (25, 20), (60, 20)])
def test_pages_near_and_deep(dated, page, size, cut):
    found = [r.id for r in cut(dated, "at", "id", page, size).collect()]
    assert found == _expected((page - 1) * size, size)


@pytest.mark.parametrize("cut", [pages.page_of, pages.page_by_position])
def test_repeated_keys_give_whole_pages(rows, cut):
    frame = rows([("a", 1), ("b", 1), ("b", 1), ("c", None)], "id string, at int")
    assert [[r.id for r in cut(frame, "at", "id", page, 1).collect()] for page in (1, 2, 3, 4, 5)] == [["a"], ["b"], ["b"], ["c"], []]


def test_every_row_is_on_one_page(spark):
    """Repeated keys across page borders, equal times, and rows without a time."""
    data = [("abc"[i % 3], None if i % 10 == 9 else _at(i // 9 * 700), i) for i in range(57)]
    frame = spark.createDataFrame(data, "id string, at timestamp_ntz, number int")
    for size in (1, 2, 7):
        walked = []
        for page in range(1, 60 // size + 2):
            walked += pages.page_by_position(frame, "at", "id", page, size).collect()
        assert sorted(r.number for r in walked) == list(range(57))
        assert [(r.at, r.id) for r in walked] == [(r.at, r.id) for r in frame.orderBy(F.col("at").desc_nulls_last(), "id").collect()]


def test_a_deep_page_reads_its_days_alone(spark, tmp_path):
    rows = spark.range(5000).select(
        F.format_string("%05d", "id").alias("key"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 7)).alias("at")
    )
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    page = pages.page_by_position(table, "at", "key", 30, 100)
    assert [r.key for r in page.collect()] == [f"{i:05d}" for i in range(2099, 1999, -1)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at," in plan and "LessThan(at," in plan


def test_keyset_pages_walk_the_whole_table(dated):
    walked, last = [], None
    while True:
        part = pages.page_after(dated, "at", "id", last, 100).collect()
        if not part:
            break
        walked += [r.id for r in part]
        last = (part[-1].at, part[-1].id)
    assert walked == _expected(0, 500)


def test_articles_page_equals_joined_page(rows):
    articles = rows([(f"{i:03d}", _at(i // 2)) for i in range(60)], "article_id string, published_at timestamp_ntz")
    records = rows([(f"r{i}", f"{i % 45:03d}", i / 100, "neutral", _at(i), False) for i in range(90)], RECORDS)
    whole = pages.page_of(latest.with_latest_score(articles, records), "published_at", "article_id", 2, 20)
    assert [tuple(r) for r in pages.articles_page(articles, records, 2, 20).collect()] == [tuple(r) for r in whole.collect()]


def test_source_filter(rows):
    articles = rows([("1", "a"), ("2", "b"), ("3", "c")], "article_id string, source_name string")
    assert pages.articles_from(articles, "a").count() == 1
    assert pages.articles_from(articles, None).count() == 0
    assert pages.articles_from_any(articles, ["a", "c"]).count() == 2
    assert pages.articles_from_any(articles, []).count() == 0


def test_heatmap_and_members_with_a_hot_source(rows):
    scores = [None, 0.329, 0.33, 0.669, 0.67]
    data = [(str(i), "hot" if i % 3 else f"s{i}", scores[i % 5]) for i in range(300)]
    articles = rows(data, "article_id string, source_name string, bias_score double")
    hot = metrics.heatmap(articles).filter("source_name = 'hot'").first()
    wanted = [s for i, (_, source, s) in enumerate(data) if source == "hot"]
    assert hot.articles == len(wanted) == 200
    assert (hot.none_articles, hot.low_articles, hot.medium_articles, hot.high_articles) == (
        wanted.count(None), wanted.count(0.329), wanted.count(0.33) + wanted.count(0.669), wanted.count(0.67),
    )
    members = metrics.articles_by_source(articles).collect()
    assert len(members) == 300
    assert {r.source_articles for r in members if r.source_name == "hot"} == {200}


def test_large_keys_are_cut_and_nothing_is_lost(rows):
    data = [(str(i), "hot" if i % 3 == 0 else f"k{i % 500}") for i in range(6000)]
    frame = rows(data, "id string, key string")
    totals = frame.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = join_group_totals(frame, totals, ["key"], "n", F.col("id"), parts=30)
    assert joined.count() == 6000
    assert joined.select("id").distinct().count() == 6000
    assert joined.filter("key = 'hot'").select("n").distinct().collect()[0].n == 2000
    # The hot key holds a third of all rows, so ten shares of about 200 rows each.
    shares = joined.filter("key = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(10))).count().collect()
    assert len(shares) == 10 and max(r["count"] for r in shares) < 300


def test_kpis_and_shares(rows):
    topics = rows(
        [("a", "p", 0.7, "critical"), ("b", "q", 0.4, "elevated"), ("c", "p", None, "stable"), ("d", "r", 0.1, "stable")],
        "topic_name string, platform string, avg_bias_score double, risk_level string",
    )
    kpis = metrics.kpi_summary(topics).first()
    assert (kpis.total_topics, kpis.critical_topics, kpis.active_platforms, round(kpis.mean_bias_score, 6)) == (4, 1, 3, 0.4)
    shares = {r.risk_level: (r.topics, r.percent) for r in metrics.risk_distribution(topics).collect()}
    assert shares == {"critical": (1, 25.0), "elevated": (1, 25.0), "stable": (2, 50.0)}
    none = metrics.risk_distribution(topics.filter("false")).collect()
    assert {(r.topics, r.percent) for r in none} == {(0, 0.0)}


def test_velocity_keeps_the_trailing_range(rows):
    data = [(T0 + timedelta(hours=h), h / 100) for h in range(0, 100, 2)]
    analyzed = rows(data, "publishedAt timestamp_ntz, biasScore double")
    series = metrics.velocity_series(analyzed, "24H").collect()
    assert sum(r.articles for r in series) == 12  # (98 - 24, 98]
    assert [r.bucket_start for r in series if r.is_peak] == [T0 + timedelta(hours=96)]


def test_salience(rows):
    data = [("1", "Tax now", T0), ("2", "tax then", T0 - timedelta(days=8)), ("3", "TAX tax", T0 - timedelta(days=1)),
            ("4", "solar", T0), ("5", "old tax", T0 - timedelta(days=20))]
    found = metrics.keyword_salience(
        rows(data, "article_id string, body string, published_at timestamp_ntz"), ["tax", "solar", "wind"]
    ).collect()
    assert {r.keyword: (r.current, r.previous, r.change, r.rank) for r in found} == {
        "tax": (2, 1, 100.0, 1), "solar": (1, 0, None, 2), "wind": (0, 0, None, 3),
    }


def test_a_hot_article_is_split_in_the_reference_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    ids = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("string")
    records = spark.range(0, 60_000, 1, 8).select(ids.alias("article_id"), F.col("id").alias("record_id"))
    articles = spark.range(0, 60_000, 2).select(F.col("id").cast("string").alias("article_id"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        lost = latest.orphan_records(records, articles)
        assert len(lost.collect()) == 40_000
        assert "skew=true" in lost._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

from __future__ import annotations

from datetime import datetime

from newsflow.operators import lag, quality
from newsflow.schemas import ARTICLES, BIAS_RECORDS, BURST_EVENTS, END_OFFSETS, OFFSETS, TREND_FORECASTS
from newsflow.sources.seed import seed_tables
from newsflow.streaming.progress import progress_offsets

T = datetime(2024, 1, 1)
U = datetime(2024, 1, 2)


def test_seed_rows_break_no_rule(spark):
    report = quality.constraint_report(seed_tables(spark, T)).collect()
    assert {r.violations for r in report} == {0}


def test_each_rule_counts_its_rows(spark):
    tables = {
        "articles": spark.createDataFrame([("a", None, "t", "b", "s", T, "1.0", None), ("a", "u", None, "b", "s", T, "1.0", T)], ARTICLES),
        "bias_records": spark.createDataFrame(
            [("r1", "a", 1.5, "biased", T, False), ("r2", "z", None, "unknown", T, True), ("r3", "z", 0.0, "x", T, None)], BIAS_RECORDS
        ),
        "burst_events": spark.createDataFrame(
            [("e1", "t", "p", 0, -0.1, "x", T, U, T), ("e2", "t", None, 3, None, None, U, T, None)], BURST_EVENTS
        ),
        "trend_forecasts": spark.createDataFrame([("f1", "t", "p", -1.0, 1.1, 0.5, "↓", T, T), ("f2", "t", "p", 1.0, None, 0.5, None, T, None)], TREND_FORECASTS),
    }
    found = {(r.table_name, r.rule): r.violations for r in quality.constraint_report(tables).collect()}
    broken = {key: n for key, n in found.items() if n}
    assert broken == {
        ("articles", "source_url not null"): 1,
        ("articles", "title not null"): 1,
        ("articles", "ingested_at not null"): 1,
        ("articles", "article_id unique"): 1,
        ("bias_records", "error_flag not null"): 1,
        ("bias_records", "bias_score in [0,1]"): 1,
        ("bias_records", "article_id references articles"): 2,
        ("burst_events", "platform not null"): 1,
        ("burst_events", "trend_direction not null"): 1,
        ("burst_events", "detection_timestamp not null"): 1,
        ("burst_events", "avg_bias_score in [0,1]"): 1,
        ("burst_events", "trend_direction known"): 1,
        ("burst_events", "article_count positive"): 1,
        ("burst_events", "window_end after window_start"): 1,
        ("trend_forecasts", "confidence_score not null"): 1,
        ("trend_forecasts", "trend_direction not null"): 1,
        ("trend_forecasts", "created_at not null"): 1,
        ("trend_forecasts", "confidence_score in [0,1]"): 1,
        ("trend_forecasts", "predicted_volume not negative"): 1,
    }


def test_empty_tables_break_no_rule(spark):
    report = quality.constraint_report({"articles": spark.createDataFrame([], ARTICLES)}).collect()
    assert {r.violations for r in report} == {0} and len(report) == 9


def test_lag_cases(spark):
    committed = spark.createDataFrame(
        [("g", "t", 0, 400), ("g", "t", 1, -1), ("g", "t", 2, 50), ("g", "u", 0, 7), ("h", "t", 0, 999)], OFFSETS
    )
    ends = spark.createDataFrame([("t", 0, 900), ("t", 1, 499), ("t", 2, 40)], END_OFFSETS)
    lags = lag.partition_lag(committed, ends)
    assert {(r.group_id, r.topic, r.partition): r.lag for r in lags.collect()} == {
        ("g", "t", 0): 500, ("g", "t", 1): 500, ("g", "t", 2): 0, ("g", "u", 0): 0, ("h", "t", 0): 0,
    }
    at_limit = {r.group_id: r for r in lag.group_lag(lags, 1000).collect()}
    assert (at_limit["g"].total_lag, at_limit["g"].breached) == (1000, False)
    assert [(p.topic, p.partition, p.lag) for p in at_limit["g"].partitions][:2] == [("t", 0, 500), ("t", 1, 500)]
    assert lag.group_lag(lags, 999).filter("group_id = 'g'").first().breached


def test_lag_of_a_progress_report(spark):
    report = {
        "sources": [
            {"endOffset": '{"raw-news":{"0":10,"1":5}}', "latestOffset": {"raw-news": {"0": 25, "1": 5}}},
            {"endOffset": {"logOffset": 3}, "latestOffset": None},
        ]
    }
    lags = lag.partition_lag(*progress_offsets(spark, "scoring", report)).collect()
    assert {(r.topic, r.partition): r.lag for r in lags} == {("raw-news", 0): 15, ("raw-news", 1): 0}


def test_salience_of_many_keywords(spark):
    """Words of one pass and of several passes; overlaps, repeats, capitals, empty and unknown words."""
    from datetime import datetime, timedelta

    from newsflow.operators import metrics

    bodies = ["The cat sat", "concatenate THE", "", None, "cat cat", "dog"]
    rows = [(b, datetime(2024, 1, 20) - timedelta(days=2 * i)) for i, b in enumerate(bodies)]
    articles = spark.createDataFrame(rows, "body string, published_at timestamp_ntz")
    words = ["cat", "the", "Cat", "at", "", "zebra", "dog", "cat", None]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    wanted = {
        w: tuple(sum(w.lower() in b.lower() for b in bodies[part] if b is not None) for part in (slice(0, 4), slice(4, 6)))
        for w in words
        if w is not None
    }
    for at_once in (50_000, 2):
        found = metrics.keyword_salience(articles, table, at_once=at_once).collect()
        assert {r.keyword: (r.current, r.previous) for r in found} == wanted and len(found) == len(wanted)
        assert sorted(r["rank"] for r in found) == list(range(1, len(found) + 1))

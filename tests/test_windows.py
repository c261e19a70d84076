from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators import windows

MINUTE = 60_000
START = datetime(2024, 1, 1)
SCHEMA = "articleId string, title string, sourceName string, publishedAt timestamp_ntz, biasScore double"


def _burst(n, minute, title="t", source="s", score=0.5, prefix="m"):
    base = START + timedelta(minutes=minute)
    return [
        (f"{prefix}{minute}-{i}", title, source, base + timedelta(seconds=i * 59 / max(n, 1)), score) for i in range(n)
    ]


def _directed(df, **options):
    return windows.with_direction(windows.window_counts(df, MINUTE, **options))


@pytest.mark.parametrize(("ms", "text"), [(60_000, "60 seconds"), (1500, "1 seconds"), (10, "1 seconds")])
def test_window_length(ms, text):
    assert windows.window_length(ms) == text


def test_keys(rows):
    data = [
        (None, "s"), ("t", None), ("t", " "), ("a|b", "c"), ("a", "b|c"), ("x", "y"),
    ]
    found = rows(data, "title string, source string").select(
        windows.composite_key(F.col("title"), F.col("source")).alias("key")
    )
    keys = [r.key for r in found.collect()]
    assert keys == ["unknown|s", "t|Unknown", "t| ", "a|b|c", "a|b|c", "x|y"]
    topics = [r.t for r in found.select(windows.topic_of(F.col("key")).alias("t")).collect()]
    assert topics == ["unknown", "t", "t", "a", "a", "x"]


def test_colliding_pairs_share_a_window(rows):
    data = _burst(2, 0, "a|b", "c", prefix="x") + _burst(3, 0, "a", "b|c", prefix="y")
    found = _directed(rows(data, SCHEMA)).collect()
    assert len(found) == 1
    assert (found[0].topic_name, found[0].volume) == ("a", 5)
    # Both sources are named; the later message decides, and at equal times the greater name.
    assert found[0].platform == "b|c"


def test_blank_and_missing_sources_show_as_unknown(rows):
    data = [
        ("1", "t", None, START, None),
        ("2", "u", " \t", START, None),
        ("3", "v", "named", START, None),
    ]
    found = {r.topic_key: r.platform for r in _directed(rows(data, SCHEMA)).collect()}
    assert found == {"t|Unknown": "Unknown", "u| \t": "Unknown", "v|named": "named"}


def test_missing_source_and_the_word_unknown_share_a_key(rows):
    data = [("1", "t", None, START, 0.2), ("2", "t", "Unknown", START + timedelta(seconds=1), 0.4)]
    found = _directed(rows(data, SCHEMA)).collect()
    assert [(r.volume, r.platform, round(r.avg_bias_score, 6)) for r in found] == [(2, "Unknown", 0.3)]


def test_mean_skips_nulls_and_is_null_without_scores(rows):
    data = [("1", "t", "s", START, 0.2), ("2", "t", "s", START, None), ("3", "u", "s", START, None)]
    found = {r.topic_name: r.avg_bias_score for r in _directed(rows(data, SCHEMA)).collect()}
    assert found == {"t": 0.2, "u": None}


def test_threshold_is_exclusive_and_boundary_opens_a_window(rows):
    data = _burst(3, 0) + [("edge", "t", "s", START + timedelta(minutes=1), 0.5)]
    frame = rows(data, SCHEMA)
    assert windows.burst_detection(frame, 3, MINUTE).count() == 0
    found = windows.burst_detection(frame, 2, MINUTE).collect()
    assert [(r.article_count, r.window_start, r.window_end) for r in found] == [
        (3, START, START + timedelta(minutes=1))
    ]
    assert found[0].detection_timestamp == found[0].window_end


def test_directions_look_back_past_empty_and_small_windows(rows):
    # 100, then 105 (flat), 112 (up), nothing, 2 (down, below the threshold), 100 (up against the 2).
    data = _burst(100, 0) + _burst(105, 1) + _burst(112, 2) + _burst(2, 4) + _burst(100, 5)
    bursts = windows.burst_detection(rows(data, SCHEMA), 50, MINUTE).orderBy("window_start").collect()
    assert [(r.article_count, r.trend_direction) for r in bursts] == [(100, "→"), (105, "→"), (112, "↑"), (100, "↑")]
    forecasts = windows.trend_forecast(rows(data, SCHEMA), 50, MINUTE).orderBy("created_at").collect()
    assert [(r.predicted_volume, r.trend_direction) for r in forecasts] == [
        (100, "→"), (105, "→"), (112, "↑"), (2, "↓"), (100, "↑")
    ]


def test_previous_volume_crosses_months(rows):
    data = []
    for days, n in ((0, 4), (30, 5), (31, 6), (100, 2), (101, 9)):
        data += [(f"{days}-{i}", "t", "s", START + timedelta(days=days), 0.1) for i in range(n)]
    data += [("other", "z", "s", START + timedelta(days=40), 0.1)]
    found = _directed(rows(data, SCHEMA)).filter("topic_name = 't'").orderBy("window_start").collect()
    assert [(r.volume, r.previous_volume) for r in found] == [(4, None), (5, 4), (6, 5), (2, 6), (9, 2)]


def test_confidence_and_horizon(rows):
    data = _burst(5, 0) + _burst(10, 1) + _burst(20, 2)
    frame = rows(data, SCHEMA)
    found = windows.trend_forecast(frame, 10, MINUTE).orderBy("created_at").collect()
    assert [r.confidence_score for r in found] == [0.5, 1.0, 1.0]
    assert found[0].forecast_horizon == START + timedelta(minutes=61)
    assert {r.confidence_score for r in windows.trend_forecast(frame, 0, MINUTE).collect()} == {1.0}


def test_unreal_dates_are_counted_at_analysis_time(rows):
    data = [("1", "t", "s", "2024-13-15T10:30:00Z", 0.1, "2024-01-01T00:00:10Z"), ("2", "t", "s", "2024-01-01T00:00:20Z", 0.3, "2024-02-01T00:00:00Z")]
    frame = rows(data, "articleId string, title string, sourceName string, publishedAt string, biasScore double, analysisTimestamp string")
    found = _directed(windows.with_event_time(frame)).collect()
    assert [r.volume for r in found] == [2]


def test_sliding_windows(rows):
    found = windows.window_counts(rows(_burst(1, 0), SCHEMA), 3 * MINUTE, MINUTE)
    assert found.count() == 3


def test_ids_are_stable_and_unique(rows):
    frame = rows(_burst(3, 0) + _burst(3, 1) + _burst(3, 0, "u"), SCHEMA)
    first = {r.forecast_id for r in windows.trend_forecast(frame, 1, MINUTE).collect()}
    again = {r.forecast_id for r in windows.trend_forecast(frame.repartition(3), 1, MINUTE).collect()}
    bursts = {r.event_id for r in windows.burst_detection(frame, 1, MINUTE).collect()}
    assert first == again
    assert len(first) == len(bursts) == 3
    assert not first & bursts


def test_every_burst_window_has_a_forecast(rows):
    frame = rows(_burst(9, 0) + _burst(2, 1) + _burst(7, 2, "u"), SCHEMA)
    bursts = {(r.topic_name, r.window_end) for r in windows.burst_detection(frame, 3, MINUTE).collect()}
    forecasts = {(r.topic_name, r.created_at) for r in windows.trend_forecast(frame, 3, MINUTE).collect()}
    assert bursts < forecasts


def test_hot_topic_is_combined_before_the_shuffle(rows):
    plan = windows.trend_forecast(rows(_burst(9, 0), SCHEMA), 3, MINUTE)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan
    raw_shuffle = plan.index("Exchange hashpartitioning(window")
    assert plan.index("partial_count(1)") > raw_shuffle  # plans print top down: the partial step feeds the shuffle


def test_raw_rows_are_scanned_once(spark, tmp_path, rows):
    rows(_burst(9, 0) + _burst(2, 1), SCHEMA).write.parquet(str(tmp_path / "in"))
    directed = _directed(spark.read.parquet(str(tmp_path / "in")))
    directed.collect()
    final = directed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_a_time_far_past_the_analysis_is_not_believed(rows):
    told = ["2099-01-01T00:00:00Z", "2024-01-02T12:00:00Z"]
    frame = rows([(t, "2024-01-02T00:00:00Z") for t in told], "publishedAt string, analysisTimestamp string")
    found = windows.with_event_time(frame).select(F.date_format("publishedAt", "yyyy-MM-dd HH").alias("at")).collect()
    assert [r.at for r in found] == ["2024-01-02 00", "2024-01-02 12"]


def test_a_time_that_nothing_bounds_is_not_believed(rows):
    told = [("1", "2099-01-01T00:00:00Z", None), ("2", "2024-01-02T12:00:00Z", "no date"), ("3", "no date", None)]
    frame = rows(told, "id string, publishedAt string, analysisTimestamp string")
    assert sorted(r.id for r in windows.without_event_time(windows.with_event_time(frame)).collect()) == ["1", "2", "3"]
    received = frame.withColumn("at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    timed = windows.with_event_time(received, received="at")
    found = {r.id: r.publishedAt for r in timed.withColumn("publishedAt", F.date_format("publishedAt", "dd HH")).collect()}
    assert found == {"1": "02 00", "2": "02 12", "3": "02 00"} and windows.without_event_time(timed).count() == 0

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsflow.operators.scoring import score_keywords
from newsflow.schemas import BURST_EVENTS, RAW_MESSAGE
from newsflow.sources import session, sinks, streams
from newsflow.sources.seed import seed_tables

T0 = datetime(2024, 1, 1)


def _burst(ident, count, day=0, platform="p", mark="↑"):
    start = T0 + timedelta(days=day)
    return ident, "t", platform, count, 0.5, mark, start, start + timedelta(minutes=1), start + timedelta(minutes=1)


def _stored(spark, path):
    return {r.event_id: r for r in sinks.read_table(spark, path, BURST_EVENTS).collect()}


@pytest.mark.parametrize("day_of", [None, "window_start"])
def test_insert_if_absent(spark, tmp_path, day_of):
    path = str(tmp_path / "bursts")

    def insert(*bursts):
        sinks.insert_if_absent(spark.createDataFrame(list(bursts), BURST_EVENTS), path, "event_id", ["article_count"], day_of)

    insert(_burst("a", 1), _burst("b", 2, platform=None, mark=None))
    insert(_burst("a", 9), _burst("c", 4, day=40), _burst("c", 3, day=40))
    insert(_burst("a", 9), _burst("c", 4, day=40), _burst("c", 3, day=40))
    found = _stored(spark, path)
    assert {k: r.article_count for k, r in found.items()} == {"a": 1, "b": 2, "c": 3}
    assert (found["b"].platform, found["b"].trend_direction) == ("Unknown", "→")
    assert spark.read.parquet(path).count() == 3


def test_empty_batches_are_fine(spark, tmp_path):
    empty = spark.createDataFrame([], BURST_EVENTS)
    sinks.insert_if_absent(empty, str(tmp_path / "x"), "event_id", ["article_count"], "window_start")
    assert _stored(spark, str(tmp_path / "x")) == {}


def test_key_test_reads_the_batch_days_only(spark, tmp_path):
    path = str(tmp_path / "bursts")
    for day in (0, 1, 2):
        sinks.insert_if_absent(
            spark.createDataFrame([_burst(f"d{day}", 1, day)], BURST_EVENTS), path, "event_id", ["article_count"], "window_start"
        )
    days = {r.day for r in spark.read.parquet(path).select("day").distinct().collect()}
    assert len(days) == 3


def test_append_batch_replaces_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([(1,), (2,)], "n int")
    for batch_id in (0, 1, 1, 0):
        sinks.append_batch(batch, path, "first", batch_id)
    assert spark.read.parquet(path).count() == 4
    # Another checkpoint starts at batch 0 again and must not replace what the first one wrote.
    sinks.append_batch(batch, path, "second", 0)
    assert spark.read.parquet(path).count() == 6


def _analyzed(spark, ids):
    raw = [(i, "u", f"title {i}", "body", "s", "2024-01-01T00:00:00Z", "1.0") for i in ids]
    frame = spark.createDataFrame(raw, RAW_MESSAGE)
    return score_keywords(frame).withColumn("analysisTimestamp", F.lit("2024-01-02T00:00:00Z"))


def test_articles_once_records_always(spark, tmp_path):
    write = sinks.save_analyzed(str(tmp_path / "a"), str(tmp_path / "r"), "first")
    write(_analyzed(spark, ["1", "2"]), 0)
    write(_analyzed(spark, ["2", "3"]), 1)
    write(_analyzed(spark, ["2", "3"]), 1)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4


def test_a_replay_moves_no_other_column_than_the_key(spark, tmp_path, monkeypatch):
    path, batch = str(tmp_path / "t"), spark.createDataFrame([("1", "x"), (None, "y"), ("1", "z")], "id string, body string")
    sinks.insert_if_absent(batch, path, "id", ["body"], None, {})
    stored = sorted(map(str, spark.read.parquet(path).collect()))
    assert len(stored) == 2
    calls, absent_rows = [], sinks.absent_rows
    monkeypatch.setattr(sinks, "absent_rows", lambda *given: calls.append(1) or absent_rows(*given))
    sinks.insert_if_absent(batch, path, "id", ["body"], None, {})
    assert calls == [] and sorted(map(str, spark.read.parquet(path).collect())) == stored
    sinks.insert_if_absent(batch.union(spark.createDataFrame([("2", "w")], batch.schema)), path, "id", ["body"], None, {})
    assert spark.read.parquet(path).count() == 3


def test_sound_and_broken_rows_part(spark, tmp_path):
    batch = spark.createDataFrame([("1", None), ("2", "title"), ("3", None)], "articleId string, error_reason string")
    write = sinks.save_validated(str(tmp_path / "ok"), str(tmp_path / "bad"), "first")
    for batch_id in (0, 0, 1):
        write(batch, batch_id)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 4
    assert [r.error_reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["title", "title"]


def test_seed_load_is_repeatable(spark, tmp_path):
    for _ in range(2):
        for name, table in seed_tables(spark, T0).items():
            key = table.columns[0]
            sinks.insert_if_absent(table, str(tmp_path / name), key, [key], None, {})
    assert {n: spark.read.parquet(str(tmp_path / n)).count() for n in seed_tables(spark, T0)} == {
        "articles": 5, "bias_records": 5, "burst_events": 5, "trend_forecasts": 5,
    }


def test_payloads_write_nulls(spark, rows):
    raw = spark.createDataFrame([("1", "u", "t", None, "s", "p", "1.0")], RAW_MESSAGE)
    row = streams.raw_payloads(raw).first()
    assert row.key == "1"
    assert json.loads(row.value) == {
        "articleId": "1", "sourceUrl": "u", "title": "t", "body": None, "sourceName": "s", "publishedAt": "p", "schemaVersion": "1.0",
    }
    analyzed = score_keywords(raw).withColumn("analysisTimestamp", F.lit("now"))
    message = json.loads(streams.analyzed_payloads(analyzed).first().value)
    assert list(message) == [
        "articleId", "sourceUrl", "title", "body", "sourceName", "publishedAt", "schemaVersion", "biasScore", "biasLabel",
        "analysisTimestamp", "errorFlag",
    ]
    assert (message["biasScore"], message["errorFlag"]) == (None, True)


def test_prediction_payloads(spark):
    tables = seed_tables(spark, T0)
    messages = [json.loads(r.value) for r in streams.prediction_payloads(tables["burst_events"], tables["trend_forecasts"]).collect()]
    bursts = [m for m in messages if "eventId" in m]
    forecasts = [m for m in messages if "forecastId" in m]
    assert len(bursts) == len(forecasts) == 5
    assert bursts[0]["windowStart"] == "2023-12-31T23:45:00Z"
    assert forecasts[0]["predictedVolume"] == 14 and forecasts[0]["forecastHorizon"] == "2024-01-01T01:00:00Z"


def test_topic_options():
    options = streams.topic_options("b1:9092,b2:9092", ["predictions", "analyzed-news"], "latest")
    assert options["subscribe"] == "predictions,analyzed-news"
    assert options["startingOffsets"] == "latest"


def test_delivery_rows(rows):
    schema = "session_id string, event_type string, article_id string, number int"
    sent = rows([("s1", "burst_event", "a1", 0), ("s1", "burst_event", "a1", 1), ("s1", "burst_event", None, 0)], schema)
    found = sinks.delivery_rows(sent, F.col("number"), F.lit(T0)).collect()
    assert [json.loads(r.payload) for r in found] == [{"articleId": "a1"}, {"articleId": "a1"}, {"articleId": None}]
    assert len({r.log_id for r in found}) == 3


def test_null_keys_are_inserted_once(spark, tmp_path):
    path = str(tmp_path / "live")
    for _ in range(2):
        batch = spark.createDataFrame([(None, 1), ("a", 2)], "id string, n int")
        sinks.insert_if_absent(batch, path, "id", ["n"], None, {})
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [("a", 2), (None, 1)]


def _snapshot(spark, tmp_path, saved_at):
    articles = spark.createDataFrame([(str(i), T0 + timedelta(minutes=i)) for i in range(70)], "id string, at timestamp_ntz")
    sinks.write_snapshot({"articles": (articles, "at", "id")}, str(tmp_path), saved_at)
    now = F.lit("2024-01-02T00:00:00Z").cast("timestamp")
    return sinks.read_snapshot(spark, str(tmp_path), "articles", now)


@pytest.mark.parametrize(
    ("saved_at", "kept"),
    [
        ("2024-01-01T23:00:00Z", 50),
        ("2024-01-01T00:00:00Z", 50),
        ("2023-12-31T23:59:59Z", 0),
        ("2024-01-03T00:00:00Z", 50),
        ("not a date", 0),
    ],
)
def test_snapshot_age(spark, tmp_path, saved_at, kept):
    found = _snapshot(spark, tmp_path, saved_at)
    assert found.count() == kept
    assert found.columns == ["id", "at"]


def test_snapshot_of_another_version_is_empty(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2, "2024-01-02T00:00:00Z")], "id string, version int, saved_at string")
    assert sinks.fresh_only(rows, F.lit("2024-01-02T00:00:00Z").cast("timestamp")).count() == 0


def test_shared_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.fresh_dir(spark, "x").startswith(named)
    assert session.fresh_dir(spark, "x") != session.fresh_dir(spark, "x")

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsflow.operators import windows
from newsflow.operators.live import upsert_latest
from newsflow.sources import sinks, streams
from newsflow.streaming import live as stream_live
from newsflow.streaming.run import drain_batches, drain_quiet, drain_to_parquet
from newsflow.streaming.windows import (
    arrivals,
    directed_windows,
    on_time,
    quiet_arrivals,
    quiet_windows,
    stream_forecasts,
    too_late,
)

MINUTE = 60_000
START = datetime(2024, 1, 1)
SCHEMA = "articleId string, title string, sourceName string, publishedAt timestamp, biasScore double"


def _messages(minute, n, title="t", source="s"):
    base = START + timedelta(minutes=minute)
    return [(f"{title}{minute}-{i}", title, source, base + timedelta(seconds=i % 60), (i % 7) / 10) for i in range(n)]


def _write(spark, path, number, data, schema=SCHEMA):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={number}")


def _stream(spark, path, schema=SCHEMA, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")


BATCHES = [
    _messages(0, 10) + _messages(0, 3, "u", None),
    _messages(1, 4) + _messages(2, 12),
    _messages(5, 2) + _messages(6, 20, "u", None),
    _messages(7, 30) + _messages(9, 1, "end"),
]


def _settled(df):
    return sorted(tuple(round(v, 10) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    for number, data in enumerate(BATCHES):
        _write(spark, str(tmp_path / "in"), number, data)
    whole = spark.createDataFrame([m for data in BATCHES for m in data], SCHEMA)
    last = START + timedelta(minutes=9)
    directed = drain_to_parquet(directed_windows(_stream(spark, str(tmp_path / "in")), MINUTE, delay="0 seconds"), str(tmp_path / "d"))
    bursts, forecasts = windows.to_bursts(directed, 5), windows.to_forecasts(directed, 5)
    assert _settled(bursts) == _settled(windows.burst_detection(whole, 5, MINUTE).filter(F.col("window_end") <= last))
    wanted = windows.trend_forecast(whole, 5, MINUTE).filter(F.col("created_at") <= last)
    assert _settled(forecasts) == _settled(wanted)
    assert bursts.count() == 4 and forecasts.count() == 7


def test_a_clock_closes_the_last_windows(spark, tmp_path):
    data = _messages(0, 4) + _messages(1, 7)
    _write(spark, str(tmp_path / "in"), 0, data)
    _write(spark, str(tmp_path / "clock"), 0, [(START + timedelta(minutes=5),)], "publishedAt timestamp")
    clock = _stream(spark, str(tmp_path / "clock"), "publishedAt timestamp")
    stream = stream_forecasts(_stream(spark, str(tmp_path / "in")), 5, MINUTE, delay="0 seconds", clock=clock)
    found = drain_to_parquet(stream, str(tmp_path / "f"))
    assert _settled(found) == _settled(windows.trend_forecast(spark.createDataFrame(data, SCHEMA), 5, MINUTE))
    assert found.count() == 2


def test_restart_continues_and_adds_nothing_twice(spark, tmp_path):
    place, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    write = sinks.save_predictions(f"{place}/bursts", f"{place}/forecasts", 5)
    for number, data in enumerate(BATCHES):
        _write(spark, str(tmp_path / "in"), number, data)
        if number % 2:
            drain_batches(directed_windows(_stream(spark, str(tmp_path / "in")), MINUTE, delay="0 seconds"), write, checkpoint)
    assert spark.read.parquet(f"{place}/forecasts").count() == 7
    # A new checkpoint replays everything; the ids are the same, so the tables stay as they are.
    replay = _stream(spark, str(tmp_path / "in"), files=100)
    drain_batches(directed_windows(replay, MINUTE, delay="0 seconds"), write, str(tmp_path / "again"))
    assert spark.read.parquet(f"{place}/forecasts").count() == 7
    assert spark.read.parquet(f"{place}/bursts").count() == 4
    directions = {(r.topic_name, r.window_start): r.trend_direction for r in spark.read.parquet(f"{place}/bursts").collect()}
    assert directions["t", START] == "→"
    assert directions["t", START + timedelta(minutes=2)] == "↑"


def test_late_rows_are_given_apart(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), 0, _messages(0, 5) + _messages(10, 1, "end"))
    # Lateness is judged by the watermark of the batch before, so the late rows come one batch further on.
    _write(spark, str(tmp_path / "in"), 1, _messages(11, 1, "end"))
    late = [(f"late{i}", "t", "s", START + timedelta(seconds=30), 0.1) for i in range(3)]
    _write(spark, str(tmp_path / "in"), 2, late + [("new", "t", "s", START + timedelta(minutes=12), None)])
    _write(spark, str(tmp_path / "in"), 3, _messages(20, 1, "end"))
    stream = arrivals(_stream(spark, str(tmp_path / "in")), MINUTE, delay="0 seconds")
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in too_late(found).select("topic_key", "window_start", "volume").collect()] == [("t|s", START, 3)]
    windows_of_t = on_time(found).filter("topic_name = 't'").orderBy("window_start")
    assert [(r.volume, r.previous_volume, r.avg_bias_score is None) for r in windows_of_t.collect()] == [(5, None, False), (1, 5, True)]
    totals = [r.observedMetrics["arrivals"].asDict() for r in query.recentProgress if "arrivals" in r.observedMetrics]
    assert sum(t["late"] for t in totals) == 3
    assert sum(t["on_time"] for t in totals) == on_time(found).agg(F.sum("volume")).first()[0]


def test_quiet_windows_need_no_clock(spark, tmp_path):
    data = _messages(0, 5) + _messages(1, 9) + _messages(4, 2) + _messages(0, 3, "u", None)
    _write(spark, str(tmp_path / "in"), 0, data)
    directed = quiet_windows(_stream(spark, str(tmp_path / "in")), MINUTE, quiet_ms=1000, delay_ms=MINUTE)
    found = windows.to_forecasts(drain_quiet(directed, str(tmp_path / "out"), 1000), 5)
    assert _settled(found) == _settled(windows.trend_forecast(spark.createDataFrame(data, SCHEMA), 5, MINUTE))
    assert found.count() == 4


def test_quiet_windows_judge_lateness_by_key(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), 0, _messages(0, 5) + _messages(10, 1))
    # The other key's early rows are not late; those of a closed window are.
    _write(spark, str(tmp_path / "in"), 1, _messages(0, 4, "u") + _messages(0, 2) + _messages(10, 6))
    stream = quiet_arrivals(_stream(spark, str(tmp_path / "in")), MINUTE, quiet_ms=60_000, delay_ms=0)
    found = drain_quiet(stream, str(tmp_path / "out"), 1000, str(tmp_path / "check"))
    assert {(r.topic_name, r.volume) for r in too_late(found).collect()} == {("t", 2)}
    assert {(r.topic_name, r.volume) for r in on_time(found).collect()} == {("t", 5)}


def test_raw_rows_meet_no_sort_aggregate(spark, tmp_path, capsys):
    _write(spark, str(tmp_path / "in"), 0, _messages(0, 5))
    directed_windows(_stream(spark, str(tmp_path / "in")), MINUTE, delay="0 seconds").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_delay_admits_late_rows(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), 0, _messages(0, 5) + _messages(10, 1, "end"))
    _write(spark, str(tmp_path / "in"), 1, _messages(11, 1, "end"))
    _write(spark, str(tmp_path / "in"), 2, [("late", "t", "s", START + timedelta(seconds=30), 0.1)])
    _write(spark, str(tmp_path / "in"), 3, _messages(40, 1, "end"))
    stream = stream_forecasts(_stream(spark, str(tmp_path / "in")), 5, MINUTE, delay="15 minutes")
    found = drain_to_parquet(stream, str(tmp_path / "f"))
    assert [r.predicted_volume for r in found.filter("topic_name = 't'").collect()] == [6.0]


def test_a_silent_key_is_forgotten(spark, tmp_path):
    _write(spark, str(tmp_path / "in"), 0, _messages(0, 5) + _messages(1, 9))
    _write(spark, str(tmp_path / "in"), 1, _messages(90, 1, "end"))
    _write(spark, str(tmp_path / "in"), 2, _messages(100, 7))
    _write(spark, str(tmp_path / "in"), 3, _messages(200, 1, "end"))
    stream = directed_windows(_stream(spark, str(tmp_path / "in")), MINUTE, delay="0 seconds", ttl_ms=3_600_000)
    found = drain_to_parquet(stream, str(tmp_path / "out")).filter("topic_name = 't'").orderBy("window_start")
    assert [(r.volume, r.previous_volume) for r in found.collect()] == [(5, None), (9, 5), (7, None)]


def test_first_arrival_across_batches(spark, tmp_path):
    schema = "id string, content string, at timestamp"
    _write(spark, str(tmp_path / "in"), 0, [("a", "first", START), ("b", "only", START)], schema)
    _write(spark, str(tmp_path / "in"), 1, [("a", "second", START + timedelta(minutes=1))], schema)
    stream = stream_live.dedup_stream(_stream(spark, str(tmp_path / "in"), schema), "id", "at", "1 hour")
    found = drain_to_parquet(stream, str(tmp_path / "out"))
    assert {r.id: r.content for r in found.collect()} == {"a": "first", "b": "only"}
    write = sinks.insert_batches(str(tmp_path / "table"), "id", ["at"], None, {})
    drain_batches(_stream(spark, str(tmp_path / "in"), schema), write)
    assert {r.id: r.content for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {"a": "first", "b": "only"}


def test_upserts_across_batches(spark, tmp_path):
    schema = "topic_name string, platform string, volume int, updated_at timestamp"
    data = [
        [("a", "p", 1, START), ("b", "p", 2, START + timedelta(minutes=1)), ("a", "p", 3, START + timedelta(minutes=2))],
        [("c", "p", 4, START + timedelta(minutes=3)), ("b", "p", 5, START + timedelta(minutes=4))],
    ]
    for number, part in enumerate(data):
        _write(spark, str(tmp_path / "in"), number, part, schema)
    drain_batches(_stream(spark, str(tmp_path / "in"), schema), stream_live.upsert_batches(str(tmp_path / "log"), "first"))
    merged = stream_live.read_upserted(spark, str(tmp_path / "log"))
    batch = upsert_latest(spark.createDataFrame([r for part in data for r in part], schema))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, batch.collect()))
    capped = stream_live.read_upserted(spark, str(tmp_path / "log"), cap=2).collect()
    assert {r.topic_name for r in capped} == {"b", "c"}


def test_json_files_stand_in_for_a_topic(spark, tmp_path):
    spark.createDataFrame([("1", "t")], "articleId string, title string").write.json(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), spark.read.json(str(tmp_path / "in")).schema)
    assert drain_to_parquet(stream, str(tmp_path / "out")).count() == 1


def test_end_to_end_from_payload_to_prediction(spark, tmp_path):
    """Payload text in, score and predictions out."""
    from newsflow.operators import ingest
    from newsflow.operators.scoring import analyzed_at, score_keywords

    item = '{"sourceUrl":"u","title":"News","body":"a biased text","sourceName":"Feed","publishedAt":"2024-01-01T00:00:%02dZ"}'
    payloads = ["[" + ",".join(item % i for i in range(8)) + "]", '{"articles":[' + item % 9 + "]}", "junk", '{"title":5}']
    spark.createDataFrame([(p,) for p in payloads], "value string").write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in"))
    raw = ingest.accepted(ingest.validate_raw(ingest.enrich_defaults(ingest.unwrap_payload(ingest.parse_message(stream)))))
    analyzed = analyzed_at(score_keywords(raw)).withColumn("publishedAt", F.try_to_timestamp("publishedAt"))
    stored = drain_to_parquet(analyzed.drop("value", "document", "item"), str(tmp_path / "analyzed"))
    assert stored.count() == 9
    assert stored.filter("biasScore between 0 and 1 and not errorFlag").count() == 9
    bursts = windows.burst_detection(stored, 5, MINUTE).collect()
    assert [(b.topic_name, b.platform, b.article_count) for b in bursts] == [("News", "Feed", 9)]


def test_live_tables_across_batches(spark, tmp_path):
    schema = "topic string, value string, at int"
    batches = [
        [
            ("analyzed-news", '{"articleId":"1","title":"first"}', 1),
            ("predictions", '{"eventId":"e","topicName":"t","articleCount":5}', 2),
            ("predictions", '{"eventId":', 3),
        ],
        [
            ("analyzed-news", '{"articleId":"1","title":"second"}', 4),
            ("predictions", '{"forecastId":"f","topicName":"t","platform":null,"predictedVolume":7}', 5),
            ("predictions", '{"type":"trending_topic","topic_name":"u","platform":"p","volume":1}', 6),
        ],
    ]
    for number, data in enumerate(batches):
        _write(spark, str(tmp_path / "in"), number, data, schema)
    write = stream_live.save_live(str(tmp_path / "out"), "first", F.lit("2024-06-01").cast("timestamp"), ["at"])
    drain_batches(_stream(spark, str(tmp_path / "in"), schema), write)
    read = {n: spark.read.parquet(str(tmp_path / "out" / n)).collect() for n in stream_live.LIVE_KEYS}
    assert [r.title for r in read["articles"]] == ["first"]
    assert [r.eventId for r in read["bursts"]] == ["e"]
    assert [r.forecastId for r in read["forecasts"]] == ["f"]
    topics = stream_live.read_upserted(spark, str(tmp_path / "out" / "trending")).collect()
    assert {(r.topic_name, r.platform): r.volume for r in topics} == {("t", "Unknown"): 7.0, ("u", "p"): 1.0}


def test_lag_of_a_live_query(spark, tmp_path):
    from newsflow.streaming.progress import progress_offsets

    _write(spark, str(tmp_path / "in"), 0, [("1", "t", "s", START, 0.1)])
    query = _stream(spark, str(tmp_path / "in")).writeStream.format("noop").option(
        "checkpointLocation", str(tmp_path / "check")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    committed, ends = progress_offsets(spark, "files", query.lastProgress)
    # Files have no topic partitions, so there is nothing to lag behind.
    assert committed.count() == ends.count() == 0

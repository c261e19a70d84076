"""Tables by buckets, upserts with a base, and tables that are committed together."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsflow.operators.latest import latest_scores
from newsflow.operators.live import upsert_latest
from newsflow.schemas import ARTICLES, BIAS_RECORDS
from newsflow.sources import buckets, commits, sinks, upserts
from newsflow.streaming import live

START = datetime(2024, 1, 1)
ITEM = "id string, content string, at int"


def _files(rows):
    return {r[0].replace("///", "/") for r in rows.select(F.input_file_name()).distinct().collect()}


# Tables by buckets


def _insert(spark, path, data, count=32):
    sinks.insert_if_absent(spark.createDataFrame(data, ITEM), path, "id", ["at"], None, {}, buckets=count)


def test_insert_keeps_the_first_arrival_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    _insert(spark, path, [("a", "first", 1), ("a", "second", 2), (None, "none", 1)])
    _insert(spark, path, [("a", "third", 0), ("b", "new", 3), (None, "again", 0)])
    _insert(spark, path, [])
    found = buckets.read_buckets(spark, path, spark.createDataFrame([], ITEM).schema)
    assert {(r.id, r.content) for r in found.collect()} == {("a", "first"), ("b", "new"), (None, "none")}
    assert found.count() == 3


def test_key_test_reads_the_buckets_of_the_batch_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    _insert(spark, path, [(f"k{i}", "x", i) for i in range(400)])
    batch = spark.createDataFrame([("k7", "again", 1), ("new", "x", 1)], ITEM).withColumn("bucket", buckets.bucket_of(["id"], 32))
    touched = buckets.touched(batch)
    known = buckets.read_buckets(spark, path, batch.schema, touched)
    assert len(touched) <= 2 and 0 < known.count() < 60
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in _files(known)} <= set(touched)
    assert {f.replace("///", "/") for f in known.inputFiles()} == _files(known)  # nothing else is listed
    assert buckets.read_buckets(spark, path, batch.schema, []).count() == 0
    assert buckets.read_buckets(spark, str(tmp_path / "no"), batch.schema, [1]).count() == 0


# Upserts

TOPIC = "topic_name string, platform string, volume int, updated_at timestamp"


def _topics(spark, *data):
    return spark.createDataFrame([(t, "p", v, START + timedelta(minutes=m)) for t, v, m in data], TOPIC)


BATCHES = [
    [("a", 1, 0), ("b", 2, 1), ("a", 3, 9)],
    [("c", 4, 3), ("b", 5, 4)],
    [("a", 6, 2), ("d", 7, 5)],  # an older message of a comes in a later batch
    [("b", 8, 8)],
]


def _plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def log(spark, tmp_path):
    write = upserts.upsert_batches(str(tmp_path / "log"), "first", buckets=4)
    for number, data in enumerate(BATCHES):
        write(_topics(spark, *data), number)
    return str(tmp_path / "log")


def test_messages_decide_and_not_the_time_of_writing(spark, log):
    whole = upsert_latest(_topics(spark, *(r for data in BATCHES for r in data)))
    assert _plain(upserts.read_upserted(spark, log)) == _plain(whole)
    upserts.upsert_batches(log, "first", buckets=4)(_topics(spark, *BATCHES[0]), 0)  # a replay
    upserts.upsert_batches(log, "second", buckets=4)(_topics(spark, *BATCHES[1]), 0)  # another run
    assert _plain(upserts.read_upserted(spark, log)) == _plain(whole)


def test_compaction_changes_no_row(spark, log):
    before = _plain(upserts.read_upserted(spark, log))
    assert upserts.compact_upserts(spark, log, upto={"first": 1}) == 1
    assert _plain(upserts.read_upserted(spark, log)) == before
    assert upserts.compact_upserts(spark, log) == 2 and upserts.compact_upserts(spark, log) == 3
    assert _plain(upserts.read_upserted(spark, log)) == before
    upserts.upsert_batches(log, "first", buckets=4)(_topics(spark, ("e", 9, 30), ("a", 10, 40)), 4)
    capped = {r.topic_name: r.volume for r in upserts.read_upserted(spark, log, cap=2).collect()}
    assert capped == {"e": 9, "d": 7}  # by first appearance
    assert {r.topic_name: r.volume for r in upserts.read_upserted(spark, log).collect()}["a"] == 10


def test_reads_touch_the_base_and_newer_deltas_only(spark, log):
    upserts.compact_upserts(spark, log, upto={"first": 2})
    files = _files(upserts.stored_rows(spark, log))
    assert all("/base/version=1/" in f or "/batch_id=3/" in f for f in files) and len(files) > 1


def test_a_base_without_its_marker_does_not_count(spark, log, monkeypatch):
    upserts.compact_upserts(spark, log, upto={"first": 1})
    before = _plain(upserts.read_upserted(spark, log))

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched, pytest.raises(RuntimeError):
        patched.setattr(upserts, "mark_version", stop)
        upserts.compact_upserts(spark, log)
    assert upserts.newest_version(spark, log) == (1, {"first": 1})
    assert _plain(upserts.read_upserted(spark, log)) == before
    assert upserts.compact_upserts(spark, log) == 2
    assert _plain(upserts.read_upserted(spark, log)) == before


def test_compaction_on_the_way(spark, tmp_path):
    write = upserts.upsert_batches(str(tmp_path / "log"), "first", buckets=4, compact_every=2)
    for number, data in enumerate(BATCHES):
        write(_topics(spark, *data), number)
    assert upserts.newest_version(spark, str(tmp_path / "log")) == (1, {"first": 1})
    write(_topics(spark, *BATCHES[2]), 2)  # replayed after its compaction
    whole = upsert_latest(_topics(spark, *(r for data in BATCHES for r in data)))
    assert _plain(upserts.read_upserted(spark, str(tmp_path / "log"))) == _plain(whole)


RECORD = "record_id string, article_id string, bias_score double, bias_label string, analysis_timestamp timestamp, error_flag boolean"


def test_scores_of_a_page_are_read_from_its_buckets(spark, tmp_path):
    rows = [(f"r{i}", f"a{i % 40}", i / 100, "x", START + timedelta(minutes=(i * 37) % 50), False) for i in range(90)]
    rows += [("tie1", "a1", 0.1, "x", START + timedelta(days=9), False), ("tie2", "a1", None, None, START + timedelta(days=9), True)]
    records = spark.createDataFrame(rows, RECORD)
    write = live.save_latest_scores(str(tmp_path / "s"), "first", 16)
    for part in range(3):
        write(records.filter(F.pmod(F.xxhash64("record_id"), F.lit(3)) == part), part)
    assert _plain(live.read_latest_scores(spark, str(tmp_path / "s"), buckets=16).na.fill(-1)) == _plain(latest_scores(records).na.fill(-1))
    page = spark.createDataFrame([("a1",), ("a7",), ("unknown",)], "article_id string")
    found = live.read_latest_scores(spark, str(tmp_path / "s"), page, 16)
    wanted = latest_scores(records).join(page, "article_id")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    touched = buckets.touched(page.withColumn("bucket", buckets.bucket_of(["article_id"], 16)))
    files = _files(upserts.stored_rows(spark, str(tmp_path / "s"), touched))
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= set(touched)


# Tables committed together


def _messages(spark, *ids):
    rows = [(i, f"u{i}", f"t{i}", "b", "s", "2024-01-01T00:00:00Z", "1.0", "2024-01-02T00:00:00Z", 0.5, "neutral", False) for i in ids]
    return spark.createDataFrame(
        rows,
        "articleId string, sourceUrl string, title string, body string, sourceName string, publishedAt string, "
        "schemaVersion string, analysisTimestamp string, biasScore double, biasLabel string, errorFlag boolean",
    )


def _seen(spark, path):
    articles = commits.read_committed(spark, path, "articles", ARTICLES)
    records = commits.read_committed(spark, path, "records", BIAS_RECORDS)
    return sorted(r.article_id for r in articles.collect()), sorted(r.article_id for r in records.collect())


def test_both_tables_or_neither(spark, tmp_path):
    path = str(tmp_path / "t")
    save = commits.save_analyzed_together(path, "first", 8)
    save(_messages(spark, "1", "2"), 0)
    assert _seen(spark, path) == (["1", "2"], ["1", "2"])
    tables = commits.analyzed_tables(_messages(spark, "2", "3"))
    broken = tables["records"].rows.withColumn("record_id", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(PySparkException):
        commits.write_together(path, "first", 1, tables | {"records": commits.Table(broken, "record_id")}, 8)
    # The articles of the attempt are written, but nobody sees them, and they do not count as known.
    assert buckets.read_buckets(spark, f"{path}/articles", ARTICLES).count() == 3
    assert _seen(spark, path) == (["1", "2"], ["1", "2"])
    save(_messages(spark, "2", "3"), 1)
    assert _seen(spark, path) == (["1", "2", "3"], ["1", "2", "2", "3"])
    save(_messages(spark, "2", "3"), 1)
    assert _seen(spark, path) == (["1", "2", "3"], ["1", "2", "2", "3"])
    commits.save_analyzed_together(path, "second", 8)(_messages(spark, "3", "4"), 1)
    assert _seen(spark, path) == (["1", "2", "3", "4"], ["1", "2", "2", "3", "3", "4"])


def test_nothing_is_seen_before_the_first_commit(spark, tmp_path):
    assert _seen(spark, str(tmp_path / "t")) == ([], [])

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from newsflow.operators import ingest, live

NOW = "2024-06-01T00:00:00Z"


def _received(rows, messages):
    data = [(name, topic, value if isinstance(value, str) else json.dumps(value)) for name, topic, value in messages]
    return ingest.drop_malformed(rows(data, "name string, topic string, value string"))


MESSAGES = [
    ("article", "analyzed-news", {"articleId": "1", "type": "other"}),
    ("burst", "predictions", {"eventId": "e", "topicName": "t"}),
    ("forecast", "predictions", {"forecastId": "f", "topicName": "t"}),
    ("both", "predictions", {"eventId": "e", "forecastId": "f"}),
    ("empty id", "predictions", {"eventId": "", "forecastId": "f"}),
    ("own type", "predictions", {"eventId": "e", "type": "custom"}),
    ("empty type", "predictions", {"eventId": "e", "type": ""}),
    ("number type", "predictions", {"eventId": "e", "type": 5}),
    ("no id", "predictions", {"topicName": "t"}),
    ("id of article", "predictions", {"articleId": None, "type": "custom"}),
    ("trending", "predictions", {"type": "trending_topic"}),
    ("malformed", "predictions", '{"eventId":'),
    ("blank", "predictions", ""),
]


def test_tags_and_routes(rows):
    found = live.route_messages(live.tag_messages(_received(rows, MESSAGES))).collect()
    assert {r.name: (r.type, r.route) for r in found} == {
        "article": ("article", "article"),
        "burst": ("burst_event", "burst_event"),
        "forecast": ("trend_forecast", "trend_forecast"),
        "both": ("burst_event", "burst_event"),
        "empty id": ("trend_forecast", "trend_forecast"),
        "own type": ("custom", None),
        "empty type": ("burst_event", "burst_event"),
        "number type": ("5", None),
        "no id": (None, None),
        "id of article": ("custom", "article"),
        "trending": ("trending_topic", "trending_topic"),
    }


def test_routes_are_disjoint(rows):
    tagged = live.route_messages(live.tag_messages(_received(rows, MESSAGES)))
    kinds = ["article", "burst_event", "trend_forecast", "trending_topic"]
    assert sum(live.routed(tagged, k).count() for k in kinds) == tagged.filter("route is not null").count()


def test_message_validity(rows):
    messages = [("ok", "x", {"type": "a"}), ("empty", "x", {"type": ""}), ("number", "x", {"type": 1}),
                ("none", "x", {}), ("list", "x", [{"type": "a"}]), ("null", "x", "null"), ("text", "x", '"type"')]
    found = _received(rows, messages).filter(live.is_valid_message(F.col("document"))).collect()
    assert [r.name for r in found] == ["ok"]


def test_normalized_rows(rows):
    messages = [
        ("burst", "predictions", {"topicName": "a", "platform": "p", "articleCount": 7, "predictedVolume": 9,
                                  "avgBiasScore": 0.7, "trendDirection": "↑", "detectionTimestamp": "2024-01-01T00:00:00Z"}),
        ("forecast", "predictions", {"topicName": "b", "predictedVolume": 3, "platform": None, "avgBiasScore": 0.5,
                                     "created_at": "2024-01-02T00:00:00Z"}),
        ("bare", "predictions", {"topicName": "c", "avgBiasScore": None}),
        ("zero", "predictions", {"topicName": "d", "articleCount": 0, "predictedVolume": 5}),
        ("empty topic", "predictions", {"topicName": ""}),
        ("other topic", "analyzed-news", {"topicName": "x"}),
    ]
    found = live.normalize_trending(_received(rows, messages), F.lit(NOW).cast("timestamp")).collect()
    assert {r.topic_name: tuple(r)[2:] for r in found} == {
        "a": ("p", 7.0, 0.7, "↑", "critical", "2024-01-01T00:00:00Z"),
        "b": ("Unknown", 3.0, 0.5, "→", "elevated", "2024-01-02T00:00:00Z"),
        "c": ("Unknown", 0.0, None, "→", "stable", "2024-06-01T00:00:00Z"),
        "d": ("Unknown", 0.0, None, "→", "stable", "2024-06-01T00:00:00Z"),
    }


def test_first_arrival_wins(rows):
    data = [("a", "first", 1), ("a", "second", 2), ("b", "only", 3)] + [("hot", f"v{i}", i) for i in range(500)]
    found = live.dedup_first(rows(data, "id string, content string, arrival int").repartition(5), "id", ["arrival"])
    assert {r.id: r.content for r in found.collect()} == {"a": "first", "b": "only", "hot": "v0"}


def test_upsert_keeps_the_last_and_caps_by_first_appearance(rows):
    def at(day):
        return datetime(2024, 1, day)

    data = [("t1", "p", 1, at(1)), ("t2", "p", 2, at(2)), ("t3", "p", 3, at(3)), ("t1", "p", 9, at(9)), ("t1", "q", 5, at(4))]
    frame = rows(data, "topic_name string, platform string, volume int, updated_at timestamp_ntz")
    whole = live.upsert_latest(frame).collect()
    assert {(r.topic_name, r.platform): r.volume for r in whole} == {("t1", "p"): 9, ("t2", "p"): 2, ("t3", "p"): 3, ("t1", "q"): 5}
    capped = live.upsert_latest(frame, cap=2).collect()
    assert {(r.topic_name, r.platform) for r in capped} == {("t1", "q"), ("t3", "p")}

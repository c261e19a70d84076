from __future__ import annotations

import json

from pyspark.sql import functions as F

from newsflow.functions import payload as js
from newsflow.operators import ingest
from newsflow.schemas import ANALYZED_MESSAGE, RAW_FIELDS

GOOD = {
    "articleId": "a1",
    "sourceUrl": "https://example.org/1",
    "title": "Title",
    "body": "Body",
    "sourceName": "Feed",
    "publishedAt": "2024-01-15T10:30:00Z",
    "schemaVersion": "1.0",
}


def _variants():
    """(name, message, reason) with reason None for sound messages."""
    without = lambda field: {k: v for k, v in GOOD.items() if k != field}
    return [
        ("good", GOOD, None),
        ("no id", without("articleId"), None),
        ("no version", without("schemaVersion"), None),
        ("null id", GOOD | {"articleId": None}, "articleId"),
        ("number id", GOOD | {"articleId": 7}, "articleId"),
        ("null version", GOOD | {"schemaVersion": None}, "schemaVersion"),
        ("number title", GOOD | {"title": 5}, "title"),
        ("blank title", GOOD | {"title": " \t "}, "title"),
        ("no source", without("sourceName"), "sourceName"),
        ("no time", without("publishedAt"), "publishedAt"),
        ("date only", GOOD | {"publishedAt": "2024-01-15"}, "publishedAt format"),
        ("month 13", GOOD | {"publishedAt": "2024-13-15T10:30:00Z"}, None),
        ("padded time", GOOD | {"publishedAt": " 2024-01-15T10:30:00Z\n"}, None),
        ("blank url", GOOD | {"sourceUrl": ""}, "sourceUrl"),
        ("empty body", GOOD | {"body": ""}, None),
        ("no body", without("body"), "body"),
        ("null body", GOOD | {"body": None}, "body"),
        ("first rule wins", {"body": 1}, "title"),
        ("list", [GOOD], "title"),
        ("number", 5, "object"),
        ("text", "hello", "object"),
        ("null", None, "object"),
    ]


def test_validation_rules(rows):
    data = rows([(name, json.dumps(message)) for name, message, _ in _variants()], "name string, value string")
    items = ingest.drop_malformed(data, out="item")
    checked = ingest.validate_raw(ingest.enrich_defaults(items, new_id=F.lit("new"))).collect()
    assert {r.name: r.error_reason for r in checked} == {name: reason for name, _, reason in _variants()}
    by_name = {r.name: r for r in checked}
    assert by_name["no id"].articleId == "new"
    assert by_name["no version"].schemaVersion == "1.0"
    assert by_name["padded time"].publishedAt == "2024-01-15T10:30:00Z"


def test_random_ids_by_default(rows):
    message = json.dumps({k: v for k, v in GOOD.items() if k != "articleId"})
    items = ingest.drop_malformed(rows([(message,), (message,)], "value string"), out="item")
    found = ingest.accepted(ingest.validate_raw(ingest.enrich_defaults(items))).select("articleId").distinct()
    assert found.count() == 2


def test_accepted_and_rejected_split_the_input(rows):
    data = rows([(name, json.dumps(message)) for name, message, _ in _variants()], "name string, value string")
    checked = ingest.validate_raw(ingest.enrich_defaults(ingest.drop_malformed(data, out="item")))
    sound, bad = ingest.accepted(checked), ingest.rejected(checked)
    assert sound.count() + bad.count() == len(_variants())
    assert "error_reason" not in sound.columns


def test_trim_all_but_body(rows):
    padded = {k: f" \t {v} \n" for k, v in GOOD.items()}
    items = ingest.drop_malformed(rows([(json.dumps(padded),)], "value string"), out="item")
    row = ingest.validate_raw(ingest.enrich_defaults(items)).first()
    assert row.error_reason is None
    assert {f: row[f] for f in RAW_FIELDS if f != "body"} == {f: v for f, v in GOOD.items() if f != "body"}
    assert row.body == padded["body"]


def test_unwrap(rows):
    payloads = {
        "array": '[{"n":1},{"n":2}]',
        "articles": '{"articles":[{"n":1},5,null]}',
        "single": '{"n":1}',
        "empty": "[]",
        "empty articles": '{"articles":[]}',
        "articles no list": '{"articles":5}',
        "text": "plain text",
        "nothing": "",
        "null": "null",
    }
    data = ingest.parse_message(rows(list(payloads.items()), "name string, value string"))
    found = ingest.unwrap_payload(data).select("name", "pos", js.type_of(F.col("item")).alias("kind")).collect()
    listed = {}
    for row in sorted(found, key=lambda r: (r.name, r.pos)):
        listed.setdefault(row.name, []).append(row.kind)
    assert listed == {
        "array": ["object", "object"],
        "articles": ["object", "number", "null"],
        "single": ["object"],
        "articles no list": ["object"],
        "text": ["string"],
        "nothing": ["string"],
        "null": ["null"],
    }


def test_missing_fields_lists_all(rows):
    data = rows(
        [("good", json.dumps(GOOD)), ("bad", json.dumps(GOOD | {"body": "", "title": 0, "sourceUrl": None})), ("none", "{}")],
        "name string, value string",
    )
    found = ingest.missing_fields(ingest.drop_malformed(data)).collect()
    assert {r.name: r.missing for r in found} == {
        "good": [],
        "bad": ["sourceUrl", "title", "body"],
        "none": list(RAW_FIELDS),
    }


def test_whitespace_passes_the_second_check_only(rows):
    message = json.dumps(GOOD | {"title": "   "})
    data = rows([(message,)], "value string")
    assert ingest.missing_fields(ingest.drop_malformed(data)).first().missing == []
    assert ingest.validate_raw(ingest.enrich_defaults(ingest.drop_malformed(data, out="item"))).first().error_reason == "title"


def test_decode_drops_bad_bytes(rows):
    data = rows([(bytearray(b'{"a":1}'),), (bytearray(b'{"a":"\xff"}'),), (None,)], "value binary")
    assert ingest.drop_malformed(ingest.decode_text(data)).count() == 1


def test_typed_reading_strict_and_lenient(rows):
    sound = json.dumps(GOOD | {"biasScore": None, "errorFlag": True})
    extra = json.dumps(GOOD | {"other": 1})
    wrong = json.dumps(GOOD | {"biasScore": "high"})
    part = json.dumps({"title": "only"})
    data = rows(
        [("sound", sound), ("extra", extra), ("wrong", wrong), ("part", part), ("bad", sound[:-1]), ("empty", ""), ("list", "[1]")],
        "name string, value string",
    )
    lenient = ingest.read_typed(data, ANALYZED_MESSAGE)
    strict = ingest.read_typed(data, ANALYZED_MESSAGE, strict=True)
    assert {r.name for r in lenient.collect()} == {"sound", "extra", "part"}
    assert {r.name for r in strict.collect()} == {"sound", "part"}
    row = strict.filter("name = 'sound'").first().message
    assert (row.title, row.biasScore, row.errorFlag) == ("Title", None, True)


def test_text_is_parsed_once(rows):
    data = rows([('{"a":1}',)], "value string")
    kept = ingest.drop_malformed(data).filter(js.type_of(F.col("document")) == "object")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("ParseJson") <= 3  # probe, and the two of the rare branch


def test_forged_end_marks_are_no_json(rows):
    mark = "<end of message>>"
    texts = [f'1,"<{mark}"', f'1,"\\u003c{mark}"', f'1,"\\u003c{mark}"]', f'1,"\\u003c{mark}",2', f'"<{mark}"', '"\\u0041"', "1 2", "1]", "1}"]
    kept = ingest.drop_malformed(rows(list(enumerate(texts)), "id int, value string"))
    assert sorted(r.id for r in kept.select("id").collect()) == [4, 5]

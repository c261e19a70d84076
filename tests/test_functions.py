"""Column functions against plain Python."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsflow.functions import bands, ids, scoring, text, times
from newsflow.functions import payload as js

# One Spark job per example list: few examples, many values in each.
FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _python_score(value: str) -> float:
    hits = sum(word in value.lower() for word in scoring.DEFAULT_KEYWORDS)
    part = int(hashlib.md5(value.encode()).hexdigest()[:4], 16) % 100 / 1000.0
    return round(min(1.0, min(0.9, hits * 0.15) + part + 0.05), 3)


def test_keyword_score_caps_hits(rows):
    words = list(scoring.DEFAULT_KEYWORDS)
    texts = ["", "nothing", "BIAS", "bias bias", *(" ".join(words[:n]) for n in (3, 5, 6, 7, 10))]
    found = rows([(t,) for t in texts], "t string").select("t", scoring.keyword_score(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in found} == {t: _python_score(t) for t in texts}
    assert max(r.s for r in found) < 1.05


@FEW
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60), min_size=1, max_size=60))
def test_keyword_score_equals_python(rows, texts):
    found = rows([(t,) for t in texts], "t string").select("t", scoring.keyword_score(F.col("t")).alias("s")).collect()
    for row in found:
        assert row.s == _python_score(row.t)
        assert 0 <= row.s <= 1


def test_labels_and_range(rows):
    data = [(0.5,), (0.499,), (None,), (1.0,), (0.0,), (1.01,), (-0.1,), (float("nan"),)]
    found = rows(data, "s double").select(
        scoring.score_label(F.col("s")).alias("label"), scoring.in_unit_range(F.col("s")).alias("ok")
    )
    assert [tuple(r) for r in found.collect()] == [
        ("biased", True), ("neutral", True), ("unknown", False), ("biased", True),
        ("neutral", True), ("biased", False), ("neutral", False), ("biased", False),
    ]


def test_bands(rows):
    scores = [None, 0.3, 0.30001, 0.329, 0.33, 0.6, 0.60001, 0.669, 0.67]
    found = rows([(s,) for s in scores], "s double").select(
        bands.risk_level(F.col("s")).alias("risk"), bands.colour_band(F.col("s")).alias("band")
    )
    assert [tuple(r) for r in found.collect()] == [
        ("stable", "none"), ("stable", "low"), ("elevated", "low"), ("elevated", "low"), ("elevated", "medium"),
        ("elevated", "medium"), ("critical", "medium"), ("critical", "medium"), ("critical", "high"),
    ]


def test_direction(rows):
    pairs = [(5, None), (100, 100), (105, 100), (106, 100), (95, 100), (94, 100), (1, 0)]
    found = rows(pairs, "now bigint, before bigint").select(bands.direction(F.col("now"), F.col("before")).alias("d"))
    assert [r.d for r in found.collect()] == ["→", "→", "→", "↑", "→", "↓", "↑"]


def test_whole_volume_rounds_to_even(rows):
    found = rows([(2.5,), (3.5,), (2.4,), (7.0,)], "v double").select(bands.whole_volume(F.col("v")).alias("v"))
    assert [r.v for r in found.collect()] == [2, 4, 2, 7]


def test_display_text(rows):
    volumes = rows([(0,), (999,), (1000,), (1250,), (1_049_999,)], "v bigint")
    assert [r.t for r in volumes.select(bands.volume_text(F.col("v")).alias("t")).collect()] == [
        "—", "999", "1.0K", "1.3K", "1050.0K"
    ]
    scores = rows([(None,), (0.5,), (0.49,), (0.125,), (0.145,), (1.0,)], "s double")
    assert [r.t for r in scores.select(bands.score_text(F.col("s")).alias("t")).collect()] == [
        "—", "+0.50", "0.49", "0.13", "0.14", "+1.00"
    ]


@FEW
@given(st.lists(st.floats(0, 10, allow_nan=False) | st.integers(0, 8000).map(lambda n: n / 800), min_size=1, max_size=200))
def test_fixed_text_uses_the_exact_value(rows, values):
    found = rows([(v,) for v in values], "v double").select("v", bands.fixed_text(F.col("v"), 2).alias("t")).collect()
    for row in found:
        assert row.t == str(Decimal(row.v).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_percent(rows):
    found = rows([(0.0,), (0.485,), (0.724,), (1.0,)], "c double").select(bands.percent(F.col("c")).alias("p"))
    assert [r.p for r in found.collect()] == [0, 49, 72, 100]


def test_trim_and_blank(rows):
    data = [(" \t a b　﻿\n",), (" ",), (" \t",), ("",), ("a\nb\n",)]
    found = rows(data, "t string").select(
        text.script_trim(F.col("t")).alias("trimmed"), text.is_blank(F.col("t")).alias("blank")
    )
    assert [tuple(r) for r in found.collect()] == [
        ("a b", False), ("", False), ("", True), ("", True), ("a\nb", False)
    ]


@pytest.mark.parametrize(
    ("value", "shape", "real"),
    [
        ("2024-01-15T10:30:00Z", True, True),
        ("2024-01-15T10:30:00.123456+05:30", True, True),
        ("2024-13-15T10:30:00Z", True, False),
        ("2024-01-15", False, True),
        ("2024-01-15T10:30:00", False, True),
        ("2024-01-15T10:30:00Z\n", False, None),
        ("x2024-01-15T10:30:00Z", False, False),
    ],
)
def test_iso(rows, value, shape, real):
    row = rows([(value,)], "t string").select(
        text.is_iso_8601(F.col("t")).alias("shape"), times.parse_iso(F.col("t")).isNotNull().alias("real")
    ).first()
    assert row.shape is shape
    assert real is None or row.real is real


def test_iso_text(rows):
    stamps = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60000), datetime(2024, 1, 2, 3, 4, 5, 678)]
    found = rows([(s,) for s in stamps], "t timestamp_ntz").select(times.iso_text(F.col("t")).alias("t"))
    assert [r.t for r in found.collect()] == [
        "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.060Z", "2024-01-02T03:04:05.000678Z"
    ]


def test_key_uuid(rows):
    found = rows([("a", "bc"), ("ab", "c"), ("a", None)], "x string, y string").select(
        ids.key_uuid(F.col("x"), F.col("y")).alias("id")
    )
    keys = [r.id for r in found.collect()]
    assert len(set(keys)) == 3
    checked = found.select(text.is_uuid(F.col("id")).alias("ok")).collect()
    assert all(r.ok for r in checked)


def _is_json(value: str) -> bool:
    def refuse(_):
        raise ValueError

    try:
        json.loads(value, parse_constant=refuse)
    except ValueError:
        return False
    return True


JSON_TEXTS = [
    '{"a":1}', '{"a":1} x', '{"a":1}} x', '{"a":1}] x', "1,2", '1,"k":2', "[]", "[1] 2", '"s"', "null", "", " ", "NaN",
    "{'a':1}", '{"a":01}', '{"a":1', '{"a":"x\ty"}', '{"a":1,"a":2}', " \n[1, 2]\t", "true", '1,"<<end of message>>"] x',
    '1,"<<end of message>>"', '["<<end of message>>"]', "-0.5e3", "tru", "plain text",
]


def test_parse_accepts_exactly_json(rows):
    data = rows([(t,) for t in JSON_TEXTS], "t string")
    found = js.with_parsed(data, "t", "v").select("t", F.col("v").isNotNull().alias("ok")).collect()
    assert {r.t: r.ok for r in found} == {t: _is_json(t) for t in JSON_TEXTS}


@FEW
@given(st.lists(st.text(alphabet='{}[]",:0123456789abtruefalsn \\<>', max_size=14), min_size=1, max_size=200))
def test_parse_agrees_with_python(rows, texts):
    found = js.with_parsed(rows([(t,) for t in texts], "t string"), "t", "v")
    for row in found.select("t", F.col("v").isNotNull().alias("ok")).collect():
        assert row.ok == _is_json(row.t), row.t


def test_types_and_falsy(rows):
    document = (
        '{"text":"x","empty":"","one":1,"zero":0,"half":0.0,"yes":true,"no":false,"null":null,"list":[null],"none":[],'
        '"object":{"a":null},"bare":{}}'
    )
    parsed = js.with_parsed(rows([(document,)], "t string"), "t", "v")
    names = [*json.loads(document), "absent"]
    row = parsed.select(
        *(js.type_of(js.field(F.col("v"), n)).alias(f"kind_{n}") for n in names),
        *(js.is_falsy(js.field(F.col("v"), n)).alias(f"falsy_{n}") for n in names),
    ).first()
    kinds = ["string", "string", "number", "number", "number", "boolean", "boolean", "null", "array", "array", "object", "object", None]
    assert [row[f"kind_{n}"] for n in names] == kinds
    loaded = json.loads(document)
    # A list with a null and an object with a key are not empty.
    assert {n: row[f"falsy_{n}"] for n in names} == {n: not loaded.get(n) for n in names}

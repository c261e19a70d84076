from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsflow.operators import scoring


def _load():
    return 3


def _predict(model, texts):
    if any("boom" in t for t in texts):
        raise RuntimeError("cannot")
    return [(len(t) % model / model, "neutral") for t in texts]


def _short(model, texts):
    return [(0.5, "biased")] * (len(texts) - 1) if len(texts) > 1 else [(0.25, "neutral")]


def _missing():
    raise OSError("no such model")


@pytest.fixture
def bodies(rows):
    return rows([(i, "boom" if i % 10 == 0 else "x" * i) for i in range(100)], "id int, body string").repartition(3)


def test_failing_rows_are_flagged_and_kept(bodies):
    found = {r.id: r for r in scoring.score_model(bodies, _load, _predict).collect()}
    assert len(found) == 100
    for i, row in found.items():
        if i % 10 == 0:
            assert (row.biasScore, row.biasLabel, row.errorFlag) == (None, "unknown", True)
        else:
            assert (row.biasScore, row.biasLabel, row.errorFlag) == (i % 3 / 3, "neutral", False)


def test_few_bad_rows_cost_few_calls():
    calls = []

    def predict(texts):
        calls.append(len(texts))
        return _predict(3, texts)

    texts = ["x"] * 20_000
    texts[77] = texts[12_345] = "boom"
    found = scoring._predict_each(predict, texts)
    assert [i for i, row in enumerate(found) if row[2]] == [77, 12_345]
    assert len(calls) < 70 and sum(calls) < 20_000 * 4


def test_wrong_number_of_results_falls_back_to_single_texts(bodies):
    found = scoring.score_model(bodies, _load, _short).select("biasScore").distinct().collect()
    assert [r.biasScore for r in found] == [0.25]


def test_unloadable_model_means_keyword_score(bodies):
    by_model = scoring.score_model(bodies, _missing, _predict)
    by_words = scoring.score_keywords(bodies)
    assert sorted(map(tuple, by_model.collect())) == sorted(map(tuple, by_words.collect()))


def test_model_gets_whole_texts(rows):
    long = "a" * 200_000
    frame = rows([(long,)], "body string")
    row = scoring.score_model(frame, lambda: None, lambda _m, texts: [(min(1.0, len(t) / 400_000), "neutral") for t in texts]).first()
    assert row.biasScore == 0.5


def test_null_body_counts_as_failed(rows):
    row = scoring.score_keywords(rows([(None,)], "body string")).first()
    assert (row.biasScore, row.biasLabel, row.errorFlag) == (None, "unknown", True)


def test_score_is_computed_once(rows):
    plan = scoring.score_keywords(rows([("x",)], "body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_valid_scores(rows):
    data = rows([(0.0,), (1.0,), (1.1,), (None,)], "biasScore double")
    assert scoring.valid_scores(data).count() == 2


def test_analysis_time(rows):
    stamped = scoring.analyzed_at(rows([("x",)], "body string"), F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
    assert stamped.first().analysisTimestamp == "2024-01-01T00:00:00Z"

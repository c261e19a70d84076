"""Scoring of article bodies: the built-in keyword score, or a pluggable model over Arrow batches."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions.scoring import DEFAULT_KEYWORDS, UNKNOWN, in_unit_range, keyword_score, score_label
from newsflow.functions.times import iso_text

log = logging.getLogger(__name__)

# A predictor maps a list of texts to as many (score, label) pairs and raises when it cannot.
Predict = Callable[[Sequence[str]], Sequence[tuple[float, str]]]


def score_keywords(df: DataFrame, body: str = "body", keywords: Sequence[str] = DEFAULT_KEYWORDS) -> DataFrame:
    """Add ``biasScore``, ``biasLabel`` and ``errorFlag``. A null body counts as a failed score."""
    return (
        df.withColumn("biasScore", keyword_score(F.col(body), keywords))
        .withColumn("biasLabel", score_label(F.col("biasScore")))
        .withColumn("errorFlag", F.col("biasScore").isNull())
    )


def _predict_each(predict: Predict, texts: list[str]) -> list[tuple[float | None, str, bool]]:
    """Predict one batch; when that fails, each half of it, until the bad rows are alone and only they are flagged."""
    try:
        pairs = list(predict(texts))
        if len(pairs) != len(texts):
            raise ValueError(f"predictor returned {len(pairs)} results for {len(texts)} texts")
        return [(float(score), label, False) for score, label in pairs]
    except MemoryError:
        raise
    except Exception as problem:
        if len(texts) == 1:
            log.debug("a text could not be scored: %r", problem)
            return [(None, UNKNOWN, True)]
        half = len(texts) // 2
        return _predict_each(predict, texts[:half]) + _predict_each(predict, texts[half:])


def score_model(
    df: DataFrame,
    load: Callable[[], Any],
    predict: Callable[[Any, Sequence[str]], Sequence[tuple[float, str]]],
    body: str = "body",
) -> DataFrame:
    """Add the three score columns from a model that is loaded once per Python worker.

    ``load`` is tried once on the driver first. If it fails there, the whole job uses the keyword score, so
    one result never mixes both scorers; a failure on an executor fails the task, which Spark retries.
    A text the model cannot score keeps its row with a null score, label ``unknown`` and the error flag.
    Whole texts are passed on; a length limit is the model's own business.
    """
    try:
        load()
    except Exception as problem:
        log.warning("model could not be loaded (%s); using the keyword score", problem)
        return score_keywords(df, body)

    schema = T.StructType(
        [
            T.StructField("biasScore", T.DoubleType()),
            T.StructField("biasLabel", T.StringType()),
            T.StructField("errorFlag", T.BooleanType()),
        ]
    )

    @F.pandas_udf(schema)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            rows = _predict_each(lambda part: predict(model, part), texts.tolist()) if len(texts) else []
            if failed := sum(row[2] for row in rows):
                log.warning("%d of %d texts could not be scored", failed, len(rows))
            yield pd.DataFrame(rows, columns=schema.names)

    return df.withColumn("_scored", scored(F.col(body))).select(*df.columns, "_scored.*")


def analyzed_at(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Stamp the analysis time as ISO text; pass ``when`` for reproducible output."""
    return df.withColumn("analysisTimestamp", iso_text(F.current_timestamp() if when is None else when))


def valid_scores(df: DataFrame, score: str = "biasScore") -> DataFrame:
    """Keep rows whose score is a number in [0, 1]."""
    return df.filter(in_unit_range(F.col(score)))

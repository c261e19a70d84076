"""Keyword bias score as one built-in expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default word list of the keyword scorer.
DEFAULT_KEYWORDS = (
    "caste",
    "discrimination",
    "bias",
    "prejudice",
    "oppression",
    "inequality",
    "marginalized",
    "suppressed",
    "targeted",
    "profiling",
)

# Weight per hit, cap of the hit part, constant part, label threshold.
PER_HIT, HIT_CAP, FLOOR, BIASED_FROM = 0.15, 0.9, 0.05, 0.5

BIASED, NEUTRAL, UNKNOWN = "biased", "neutral", "unknown"


def keyword_hits(text: Column, keywords: Sequence[str] = DEFAULT_KEYWORDS) -> Column:
    """How many of the words occur in the text; each counts once, anywhere, in any case."""
    lowered = F.lower(text)
    return reduce(lambda total, word: total + F.contains(lowered, F.lit(word)).cast("int"), keywords, F.lit(0))


def text_variation(text: Column) -> Column:
    """0.000 to 0.099 from the first two bytes of the text's MD5, so equal texts score alike."""
    return (F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int") % 100) / F.lit(1000.0)


def keyword_score(text: Column, keywords: Sequence[str] = DEFAULT_KEYWORDS) -> Column:
    """Score of a text. Select it unconditionally and build on the column: inside a ``when`` branch Spark
    does not share common parts and would lower the text once per word."""
    hits = F.least(F.lit(HIT_CAP), keyword_hits(text, keywords) * F.lit(PER_HIT))
    score = F.round(F.least(F.lit(1.0), hits + text_variation(text) + F.lit(FLOOR)), 3)
    # least() skips nulls, so without the factor a null text would score 1.
    return score * F.when(text.isNotNull(), F.lit(1.0))


def score_label(score: Column) -> Column:
    """Label of a score; a missing score means the scorer failed."""
    return (
        F.when(score.isNull(), F.lit(UNKNOWN)).when(score >= BIASED_FROM, F.lit(BIASED)).otherwise(F.lit(NEUTRAL))
    )


def in_unit_range(score: Column) -> Column:
    """True for a number in [0, 1]; false outside, for NaN and for null."""
    return F.coalesce(score.between(0.0, 1.0), F.lit(False))

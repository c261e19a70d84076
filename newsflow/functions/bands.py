"""Bands, directions and display text derived from scores and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction marks and their neutral default.
UP, DOWN, FLAT = "↑", "↓", "→"
DIRECTIONS = (UP, DOWN, FLAT)

# Lower bounds (exclusive) of the two upper risk levels.
CRITICAL_ABOVE, ELEVATED_ABOVE = 0.6, 0.3
RISK_LEVELS = ("critical", "elevated", "stable")

# Upper bounds (exclusive) of the two lower colour bands.
LOW_BELOW, MEDIUM_BELOW = 0.33, 0.67
COLOUR_BANDS = ("none", "low", "medium", "high")

# A window counts as a rise or fall beyond five percent of the one before.
RISE, FALL = 1.05, 0.95

DASH = "—"


def direction(volume: Column, previous: Column) -> Column:
    """Direction against the previous window of the same key; flat when there was none."""
    now, before = volume.cast("double"), previous.cast("double")
    return (
        F.when(now > before * F.lit(RISE), F.lit(UP))
        .when(now < before * F.lit(FALL), F.lit(DOWN))
        .otherwise(F.lit(FLAT))
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score > CRITICAL_ABOVE, F.lit("critical"))
        .when(score > ELEVATED_ABOVE, F.lit("elevated"))
        .otherwise(F.lit("stable"))
    )


def colour_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("none"))
        .when(score < LOW_BELOW, F.lit("low"))
        .when(score < MEDIUM_BELOW, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def whole_volume(volume: Column) -> Column:
    """Float volume to a whole number, halves to the even neighbour."""
    return F.bround(volume, 0).cast("bigint")


def percent(share: Column) -> Column:
    """Share to whole percent, halves up."""
    return F.floor(share * 100 + F.lit(0.5)).cast("int")


def fixed_text(value: Column, digits: int) -> Column:
    """A non-negative number with a fixed count of decimals, the exact binary value deciding halves.

    ``format_string`` rounds the shortest decimal form, so 1.005 (stored a little below) would become 1.01.
    The product with 10^digits is taken as a rounded part plus its exact error (Dekker's splitting), which
    puts the comparison with one half beyond doubt; an exact half goes up.
    """
    scale = 10**digits
    x = value.cast("double")
    product = x * F.lit(float(scale))
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    error = (high * F.lit(float(scale)) - product) + (x - high) * F.lit(float(scale))
    whole = F.floor(product)
    over_half = ((product - whole) - F.lit(0.5)) + error >= 0
    units = whole + F.when(over_half, 1).otherwise(0)
    return F.concat(
        F.floor(units / scale).cast("string"), F.lit("."), F.lpad((units % scale).cast("string"), digits, "0")
    )


def volume_text(volume: Column) -> Column:
    """``1.2K`` from a thousand up, the plain number below, a dash for zero."""
    return (
        F.when(volume >= 1000, F.concat(fixed_text(volume / 1000, 1), F.lit("K")))
        .when(volume > 0, volume.cast("bigint").cast("string"))
        .otherwise(F.lit(DASH))
    )


def score_text(score: Column) -> Column:
    """Two decimals, a plus sign from one half up, a dash when there is no score."""
    digits = fixed_text(score, 2)
    return F.when(score.isNull(), F.lit(DASH)).when(score >= 0.5, F.concat(F.lit("+"), digits)).otherwise(digits)


def plain_score_text(score: Column) -> Column:
    return F.when(score.isNull(), F.lit("N/A")).otherwise(fixed_text(score, 2))

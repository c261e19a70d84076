"""ISO-8601 text to timestamps and back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: datetime) -> Column:
    """A Python time as a literal. One without a zone stays as it is written; ``lit`` would read it in the zone
    of the driver's machine."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz" if value.tzinfo is None else "timestamp")


def parse_iso(value: Column) -> Column:
    """Text to an instant; null when the text is no real date, for example month 13."""
    return F.try_to_timestamp(value)


def iso_text(ts: Column) -> Column:
    """Timestamp to UTC text with no, three or six fraction digits, as many as the value needs.

    Expects session zone UTC (see ``sources.session.prepare``).
    """
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    digits = F.lpad(micros.cast("string"), 6, "0")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def plus_hours(ts: Column, hours: int = 1) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))

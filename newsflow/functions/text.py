"""Whitespace, blank and shape tests whose rules differ from Spark's own ``trim``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JSON-side trim removes (ECMAScript WhiteSpace and LineTerminator).
SCRIPT_SPACE = (
    r"[\x{0009}\x{000A}\x{000B}\x{000C}\x{000D}\x{0020}\x{00A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

# The characters a JVM "is blank" test treats as white. No-break spaces are not among them.
JVM_SPACE = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{1680}"
    r"\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
)

# Fixed value: the accepted shape of a publication time. Only the shape counts, so month 13 passes.
ISO_8601 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"

# Fixed value: the textual form of a UUID.
UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def script_trim(value: Column) -> Column:
    """Trim every Unicode space, tab, line end and byte-order mark. Spark's ``trim`` removes U+0020 only."""
    return F.regexp_replace(value, f"^{SCRIPT_SPACE}+|{SCRIPT_SPACE}+\\z", "")


def is_blank(value: Column) -> Column:
    """True when a non-null string holds nothing but JVM white space."""
    return value.rlike(f"^{JVM_SPACE}*\\z")


def is_iso_8601(value: Column) -> Column:
    return value.rlike(ISO_8601)


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID_SHAPE)

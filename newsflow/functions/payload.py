"""Untyped JSON as VARIANT: strict parsing and type tests that keep absent, null and value apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closes the probe array below; texts that may hold this mark themselves take the slower two-parse path.
_END = "<<end of message>>"


def _two_parses(text: Column) -> Column:
    """Text that parses both inside an array and inside an object is exactly one JSON value."""
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def with_parsed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add column ``out``: the text as VARIANT, SQL null unless the whole text is exactly one JSON value.

    ``try_parse_json`` stops after the first value and so accepts ``{"a":1} junk``. Parsing the text as the
    first of two array elements rejects that with one pass: anything after the value would have to reach the
    closing mark as the second element. A text can forge that mark only by holding it, plainly or with letters
    written as ``\\u`` escapes; such texts are parsed twice. The probe goes through a one-element ``explode`` because filters
    are pushed below projections (and would parse again there) but not below a generator.
    """
    probe = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(f',"{_END}"]')))
    may_forge = F.contains(F.col(text), F.lit(_END)) | F.contains(F.col(text), F.lit("\\u"))
    value = F.when(may_forge, _two_parses(F.col(text))).when(
        F.try_variant_get(F.col("_probe"), "$[1]", "string") == _END,
        F.try_variant_get(F.col("_probe"), "$[0]", "variant"),
    )
    return df.withColumn("_probe", F.explode(F.array(probe))).withColumn(out, value).drop("_probe")


# First word of a VARIANT's schema, and the JSON type it stands for.
_KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
}

# Fixed value: JSON texts that count as missing.
_FALSY = r'^(""|false|null|\[\]|\{\}|-?0+(\.0+)?([eE][+-]?[0-9]+)?)\z'


def type_of(value: Column) -> Column:
    """Coarse JSON type of a VARIANT: object, array, string, number, boolean, null; SQL null when absent."""
    kinds = F.create_map(*(F.lit(part) for pair in _KINDS.items() for part in pair))
    return F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def field(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def text_field(document: Column, name: str) -> Column:
    """The field's text if it is a JSON string, else null. A plain cast would turn 5 into '5'."""
    value = field(document, name)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(document, f"$.{name}", "string"))


def is_falsy(value: Column) -> Column:
    """Absent, null, empty text, zero, false, empty array and empty object all count as missing."""
    return F.coalesce(F.to_json(value).rlike(_FALSY), F.lit(True))

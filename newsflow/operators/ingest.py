"""From untyped payloads to validated raw articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import payload as js
from newsflow.functions.text import is_blank, is_iso_8601, is_uuid, script_trim
from newsflow.schemas import RAW_FIELDS, RAW_MESSAGE, SCHEMA_VERSION


def decode_text(df: DataFrame, binary: str = "value", out: str = "value") -> DataFrame:
    """Bytes to text; bytes that are no valid UTF-8 become null and fall out with the malformed messages."""
    return df.withColumn(out, F.try_validate_utf8(F.col(binary).cast("string")))


def drop_malformed(df: DataFrame, text: str = "value", out: str = "document") -> DataFrame:
    """Keep rows whose text is one JSON value, with the value in ``out``. A JSON ``null`` is kept as such."""
    return js.with_parsed(df, text, out).filter(F.col(out).isNotNull())


def drop_non_objects(df: DataFrame, document: str = "document") -> DataFrame:
    return df.filter(js.type_of(F.col(document)) == "object")


def parse_message(df: DataFrame, text: str = "value", out: str = "document") -> DataFrame:
    """Parse JSON text; text that is no JSON is kept as a string value. ``parsed_ok`` tells which happened."""
    return (
        js.with_parsed(df, text, "_json")
        .withColumn("parsed_ok", F.col("_json").isNotNull())
        .withColumn(out, F.coalesce(F.col("_json"), F.col(text).cast("variant")))
        .drop("_json")
    )


def unwrap_payload(df: DataFrame, document: str = "document", out: str = "item") -> DataFrame:
    """One row per item: the elements of an array, of an ``articles`` array, or else the value itself.

    An empty array gives no row. ``pos`` is the item's position in its payload.
    """
    value = F.col(document)
    nested = js.field(value, "articles")
    as_list = F.when(js.type_of(value) == "array", value).when(js.type_of(nested) == "array", nested)
    items = F.coalesce(F.try_variant_get(as_list, "$", "array<variant>"), F.array(value))
    return df.select("*", F.posexplode(items).alias("pos", out))


def enrich_defaults(df: DataFrame, item: str = "item", new_id: Column | None = None) -> DataFrame:
    """Spread the item into the raw fields, filling article id and schema version only where the key is absent.

    A key that is present with ``null`` stays null and is rejected later. ``new_id`` defaults to a random
    UUID; pass an expression over the row for reproducible ids. Each field becomes a VARIANT column.
    """
    value = F.col(item)
    fresh = F.expr("uuid()") if new_id is None else new_id
    spreads = js.type_of(value).isin("object", "array")
    defaults = {"articleId": fresh, "schemaVersion": F.lit(SCHEMA_VERSION)}

    def pick(name: str) -> Column:
        found = js.field(value, name)
        if name in defaults:
            found = F.coalesce(found, F.when(spreads, defaults[name].cast("variant")))
        return found.alias(name)

    return df.select("*", *(pick(name) for name in RAW_FIELDS))


def _text_of(name: str) -> Column:
    """The field's text if it is a JSON string, else null."""
    return F.when(F.schema_of_variant(F.col(name)) == "STRING", F.try_variant_get(F.col(name), "$", "string"))


def _unless_filled(name: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(name))


def validate_raw(df: DataFrame, item: str = "item") -> DataFrame:
    """Check enriched items field by field; ``error_reason`` names the first rule that fails, else null.

    The raw fields come out as trimmed text (body untrimmed), null where they are no JSON string. The body
    may be empty; the publication time is tested for shape only.
    """
    texts = (
        (_text_of(name) if name == "body" else script_trim(_text_of(name))).alias(name) for name in RAW_FIELDS
    )
    # Extracted once, in a generator: a filter on the reason would repeat a projection below it.
    read = F.struct(*texts, js.type_of(F.col(item)).isin("object", "array").alias("spreads"))
    kept = [c for c in df.columns if c not in RAW_FIELDS]
    fields = df.select(*kept, F.explode(F.array(read)).alias("_read")).select(*kept, "_read.*")
    reason = F.coalesce(
        F.when(~F.coalesce("spreads", F.lit(False)), F.lit("object")),
        _unless_filled("title"),
        _unless_filled("sourceName"),
        _unless_filled("publishedAt"),
        F.when(~is_iso_8601(F.col("publishedAt")), F.lit("publishedAt format")),
        _unless_filled("articleId"),
        _unless_filled("sourceUrl"),
        F.when(F.col("body").isNull(), F.lit("body")),
        _unless_filled("schemaVersion"),
    )
    return fields.withColumn("error_reason", reason).drop("spreads")


def checked_ids(rows: DataFrame, key: str) -> DataFrame:
    """Add ``error_reason`` to rows whose id a table of UUIDs would refuse; ``accepted`` and ``rejected`` part them."""
    value = F.col(key)
    reason = F.when(value.isNull() | is_blank(value), F.lit(f"{key} is missing")).when(~is_uuid(value), F.lit(f"{key} is no UUID"))
    return rows.withColumn("error_reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error_reason").isNull()).drop("error_reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error_reason").isNotNull())


def missing_fields(df: DataFrame, document: str = "document", out: str = "missing") -> DataFrame:
    """Second check, before scoring: list every raw field that is absent or falsy (so an empty body counts)."""
    value = F.col(document)
    named = F.array(*(F.when(js.is_falsy(js.field(value, name)), F.lit(name)) for name in RAW_FIELDS))
    return df.withColumn(out, F.filter(named, lambda name: name.isNotNull()))


def read_typed(
    df: DataFrame, schema: T.StructType = RAW_MESSAGE, text: str = "value", out: str = "message", strict: bool = False
) -> DataFrame:
    """Parse text into a struct, dropping rows that are malformed or hold a value of the wrong type.

    ``strict`` also drops objects with a field outside the schema, as a mapper without an ignore rule does.
    """
    corrupt = "_corrupt"
    with_corrupt = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType(), True)])
    parsed = F.from_json(
        F.col(text),
        with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "allowSingleQuotes": "false"},
    )
    # Parsed once, in a generator: filters on a projection would be pushed below it and parse again.
    read = F.struct(parsed.alias("row"), F.json_object_keys(F.col(text)).alias("keys"))
    row, keys = F.col("_read.row"), F.col("_read.keys")
    kept = df.withColumn("_read", F.explode(F.array(read))).filter(
        row.isNotNull() & row[corrupt].isNull() & keys.isNotNull()
    )
    if strict:
        known = F.array(*(F.lit(n) for n in schema.names))
        kept = kept.filter(F.size(F.array_except(keys, known)) == 0)
    return kept.withColumn(out, F.struct(*(row[n].alias(n) for n in schema.names))).drop("_read")

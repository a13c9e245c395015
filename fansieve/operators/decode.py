"""From payload bytes to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.attributes import BOOLEAN, FLOAT, INTEGER, INTEGER_LIST, STRING, STRING_LIST, canonical_type
from fansieve.functions.predicates import quote_name

# How a VARIANT names the types the six attribute types accept.
STORED = {
    BOOLEAN: "= 'BOOLEAN'",
    INTEGER: "= 'BIGINT'",
    FLOAT: "RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'",
    STRING: "= 'STRING'",
}
SQL_TYPE = {BOOLEAN: "boolean", INTEGER: "bigint", FLOAT: "double", STRING: "string"}
_ELEMENT = {STRING_LIST: STRING, INTEGER_LIST: INTEGER}


def _json_path(name: str) -> str:
    quote = '"' if '"' not in name else "'"
    if quote in name:
        raise ValueError(f"attribute name mixes both quotes: {name}")
    path = f"$[{quote}{name}{quote}]".replace("\\", "\\\\").replace("'", "\\'")
    return f"'{path}'"


def skip_empty(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Leave out zero-byte messages: they count as received, never as processed."""
    return df.where(F.octet_length(payload) > 0)


def within_size(df: DataFrame, max_bytes: int, payload: str = "payload") -> DataFrame:
    """Leave out messages larger than the byte limit."""
    if max_bytes <= 0:
        raise ValueError("max_bytes must be positive")
    return df.where(F.octet_length(payload) <= max_bytes)


def parse_payload(df: DataFrame, payload: str = "payload", into: str = "body") -> DataFrame:
    """Parse JSON text (string or UTF-8 binary) to a VARIANT; NULL if it cannot be decoded.

    Only a map counts as decodable: any other root leaves ``body`` NULL.
    """
    text = F.col(payload).cast("string") if isinstance(df.schema[payload].dataType, T.BinaryType) else F.col(payload)
    parsed = df.withColumn(into, F.try_parse_json(text))
    return parsed.withColumn(into, F.expr(f"CASE WHEN startswith(schema_of_variant({quote_name(into)}), 'OBJECT') THEN {quote_name(into)} END"))


def attribute_value(body: str, name: str, kind: str) -> str:
    """SQL text for one attribute of the VARIANT ``body``: NULL (undefined) if absent or of another type."""
    value = f"variant_get({body}, {_json_path(name)}, 'variant')"
    if kind in _ELEMENT:
        element = _ELEMENT[kind]
        kept = (
            f"filter(try_variant_get({body}, {_json_path(name)}, 'array<variant>'), "
            f"x -> schema_of_variant(x) {STORED[element]})"
        )
        values = f"transform({kept}, x -> variant_get(x, '$', '{SQL_TYPE[element]}'))"
        return f"CASE WHEN startswith(schema_of_variant({value}), 'ARRAY') THEN {values} END"
    return (
        f"CASE WHEN schema_of_variant({value}) {STORED[kind]} "
        f"THEN try_variant_get({body}, {_json_path(name)}, '{SQL_TYPE[kind]}') END"
    )


def typed_events(df: DataFrame, schema: T.StructType, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """One column per declared attribute, taken from the VARIANT; undeclared keys are ignored."""
    keep = [c for c in df.columns if c != body] if keep is None else keep
    columns = [
        F.expr(attribute_value(quote_name(body), f.name, canonical_type(f.dataType))).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*(F.col(quote_name(c)) for c in keep), *columns)


def decode_payloads(
    df: DataFrame, schema: T.StructType, payload: str = "payload", decodable: str = "decodable", max_bytes: int | None = None
) -> DataFrame:
    """Messages to typed events, with a column that tells the decodable ones."""
    rows = skip_empty(df, payload)
    if max_bytes is not None:
        rows = within_size(rows, max_bytes, payload)
    parsed = parse_payload(rows, payload, "_body").withColumn(decodable, F.col("_body").isNotNull())
    return typed_events(parsed, schema, "_body")

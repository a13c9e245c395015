"""Attribute schemas: an ordered list of (name, type), flat, declared up front."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# The six attribute types and the spellings accepted for each.
BOOLEAN = "boolean"
INTEGER = "integer"
FLOAT = "float"
STRING = "string"
STRING_LIST = "string_list"
INTEGER_LIST = "integer_list"

TYPE_NAMES = {
    "boolean": BOOLEAN,
    "bool": BOOLEAN,
    "integer": INTEGER,
    "int": INTEGER,
    "float": FLOAT,
    "double": FLOAT,
    "string": STRING,
    "str": STRING,
    "string_list": STRING_LIST,
    "integer_list": INTEGER_LIST,
    "int_list": INTEGER_LIST,
}

SPARK_TYPES = {
    BOOLEAN: T.BooleanType(),
    INTEGER: T.LongType(),
    FLOAT: T.DoubleType(),
    STRING: T.StringType(),
    STRING_LIST: T.ArrayType(T.StringType()),
    INTEGER_LIST: T.ArrayType(T.LongType()),
}


class AttributeSchemaError(ValueError):
    """An attribute declaration that cannot be used."""


def attribute_type(name: str) -> str:
    """The canonical type for a spelling such as ``int`` or ``string_list``."""
    try:
        return TYPE_NAMES[name]
    except KeyError:
        raise AttributeSchemaError(f"unknown attribute type: {name}") from None


def attribute_schema(attributes: Iterable[str | tuple[str, str]]) -> T.StructType:
    """Build the event schema from ``"name:type"`` strings or (name, type) pairs.

    Every field is nullable: NULL is the undefined value.
    """
    fields: list[T.StructField] = []
    seen: set[str] = set()
    for item in attributes:
        if isinstance(item, str):
            name, colon, type_name = item.rpartition(":")
            if not colon:
                raise AttributeSchemaError(f"expected name:type, got {item!r}")
        else:
            name, type_name = item
        if not name:
            raise AttributeSchemaError("attribute name is empty")
        if name in seen:
            raise AttributeSchemaError(f"attribute declared twice: {name}")
        seen.add(name)
        fields.append(T.StructField(name, SPARK_TYPES[attribute_type(type_name)], True))
    if not fields:
        raise AttributeSchemaError("at least one attribute is required")
    return T.StructType(fields)


def canonical_type(data_type: T.DataType) -> str | None:
    """The attribute type of a Spark column type, or None if it has none."""
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, T.ArrayType):
        if isinstance(data_type.elementType, T.StringType):
            return STRING_LIST
        if isinstance(data_type.elementType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return INTEGER_LIST
    return None


def attributes_of(schema: T.StructType) -> dict[str, str]:
    """{column: attribute type} for the columns that can be used in predicates."""
    typed = ((f.name, canonical_type(f.dataType)) for f in schema.fields)
    return {name: kind for name, kind in typed if kind is not None}

"""Attribute schemas from samples or from a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.attributes import BOOLEAN, FLOAT, INTEGER, INTEGER_LIST, STRING, STRING_LIST

_TYPE = f"""
CASE WHEN stored = 'BOOLEAN' THEN '{BOOLEAN}'
     WHEN stored = 'BIGINT' THEN '{INTEGER}'
     WHEN stored RLIKE '^(DECIMAL|DOUBLE|FLOAT)' THEN '{FLOAT}'
     WHEN stored = 'STRING' THEN '{STRING}'
     WHEN stored LIKE 'ARRAY%' AND schema_of_variant(try_variant_get(value, '$[0]', 'variant')) = 'BIGINT' THEN '{INTEGER_LIST}'
     WHEN stored LIKE 'ARRAY%' THEN '{STRING_LIST}'
END
"""


class SampleError(ValueError):
    """A sample that is not a map."""


def infer_schema(samples: DataFrame, order: list[str], payload: str = "payload", strict: bool = True) -> DataFrame:
    """(attribute, type, warning, conflict), one row per key seen in any sample.

    The type comes from the first sample, by ``order``, where the key has one. A key that is null or
    of no attribute type in all samples becomes a string, with a warning; ``conflict`` tells that
    samples disagree. With ``strict`` a sample that is not a map is an error.
    """
    parsed = samples.select(*order, F.try_parse_json(payload).alias("body"))
    if strict:
        bad = parsed.where("body IS NULL OR NOT startswith(schema_of_variant(body), 'OBJECT')")
        if not bad.isEmpty():
            raise SampleError("a sample is not a map")
    maps = parsed.where("startswith(schema_of_variant(body), 'OBJECT')")
    columns = ", ".join(f"m.`{c}`" for c in order)
    pairs = samples.sparkSession.sql(
        f"SELECT {columns}, key AS attribute, value, schema_of_variant(value) AS stored "
        "FROM {maps} m, LATERAL variant_explode(m.body)",
        maps=maps,
    )
    typed = pairs.withColumn("type", F.expr(_TYPE))
    # Maxima and minima only, so a key that occurs in every sample still aggregates map-side.
    return (
        typed.groupBy("attribute")
        .agg(
            F.expr(f"min_by(type, struct({', '.join(order)})) FILTER (WHERE type IS NOT NULL)").alias("_type"),
            (F.min("type") != F.max("type")).alias("_conflict"),
        )
        .select(
            "attribute",
            F.coalesce("_type", F.lit(STRING)).alias("type"),
            F.col("_type").isNull().alias("warning"),
            F.coalesce("_conflict", F.lit(False)).alias("conflict"),
        )
    )


def rejected_samples(samples: DataFrame, payload: str = "payload") -> DataFrame:
    """(reason, samples): how many samples say nothing of a schema, as they are no JSON or no map."""
    rows = samples.select(F.try_parse_json(payload).alias("body"))
    rows = rows.where("body IS NULL OR NOT startswith(schema_of_variant(body), 'OBJECT')")
    reason = F.when(F.col("body").isNull(), "unreadable").otherwise("not a map")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("samples"))


def schema_text(attributes: DataFrame, order: str = "attribute") -> DataFrame:
    """The ``attributes:`` block as one text. Its rows are attributes, so they are few."""
    lines = F.concat(F.lit("  - name: "), F.col("attribute"), F.lit("\n    type: "), F.col("type"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), lines.alias("line"))))
    return attributes.agg(F.concat(F.lit("attributes:\n"), F.array_join(ordered["line"], "")).alias("text"))


def catalog_type(data_type: T.DataType) -> str:
    """The attribute type for a column type; anything without a closer one is a string."""
    if isinstance(data_type, T.ArrayType):
        whole = isinstance(data_type.elementType, (T.ShortType, T.IntegerType, T.LongType))
        return INTEGER_LIST if whole else STRING_LIST
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    return STRING


def catalog_schema(df: DataFrame) -> list[tuple[int, str, str]]:
    """(ordinal, attribute, type) for every column, in column order."""
    return [(i, f.name, catalog_type(f.dataType)) for i, f in enumerate(df.schema.fields, start=1)]

"""Counters over the match result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("received", "empty", "input_dropped", "processed", "match_failures", "matched", "published")


def intake(messages: DataFrame, decodable: Column, payload: str = "payload", max_bytes: int | None = None) -> DataFrame:
    """One row per message with 0/1 counters for what happened before matching."""
    size = F.octet_length(payload)
    empty = F.coalesce(size, F.lit(0)) == 0
    dropped = ~empty & (size > max_bytes) if max_bytes is not None else F.lit(False)
    processed = ~empty & ~dropped
    return messages.select(
        *(c for c in messages.columns if c != payload),
        F.lit(1).cast("bigint").alias("received"),
        empty.cast("bigint").alias("empty"),
        dropped.cast("bigint").alias("input_dropped"),
        processed.cast("bigint").alias("processed"),
        (processed & ~F.coalesce(decodable, F.lit(False))).cast("bigint").alias("match_failures"),
    )


def counted(messages: DataFrame, ids: str = "ids") -> DataFrame:
    """Rows of ``intake`` with the ids each message matched (NULL if it was not matched at all): ``matched`` counts the message, ``published`` its output rows."""
    published = F.coalesce(F.size(F.col(ids)), F.lit(0))
    published = F.when(F.col(ids).isNull(), 0).otherwise(published).cast("bigint")
    return messages.withColumns({"matched": (published > 0).cast("bigint"), "published": published}).drop(ids)


def totals(messages: DataFrame, by: tuple[Column, ...] = ()) -> DataFrame:
    """All counters of ``counted`` messages, in total or by groups such as a time window: one aggregate, and no message is moved."""
    return messages.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))

"""Outputs: one topic per subscription."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_records(matches: DataFrame, payload: str = "payload") -> DataFrame:
    """(topic, value): the payload as it came in, ready for a per-row topic sink such as Kafka."""
    return matches.select("topic", F.col(payload).alias("value"))


def route(matches: DataFrame, path: str, mode: str = "overwrite", format: str = "parquet", by: tuple[str, ...] = ("topic",)) -> None:
    """Write one folder per topic.

    The rebalance keeps the rows of a small topic in one file and splits a heavy topic over
    several tasks and files.
    """
    spread = matches.hint("rebalance", *[F.col(c) for c in by])
    spread.write.mode(mode).format(format).partitionBy(*by).save(path)

"""Inputs: one or several subjects that carry the same kind of message."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def default_output_prefix(subjects: Mapping[str, str] | list[str], output_prefix: str | None = None) -> str:
    """The output prefix; a single input subject is its own default."""
    if not subjects:
        raise ValueError("at least one input subject is required")
    if output_prefix:
        return output_prefix
    if len(subjects) > 1:
        raise ValueError("several input subjects need an explicit output prefix")
    return next(iter(subjects))


def union_subjects(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All subjects as one DataFrame with a ``subject`` column."""
    if not frames:
        raise ValueError("at least one input subject is required")
    tagged = [df.withColumn("subject", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def read_inputs(
    spark: SparkSession,
    subjects: Mapping[str, str],
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    streaming: bool = False,
    max_files: int | None = None,
    max_bytes: int | None = None,
    **options: str,
) -> DataFrame:
    """Read ``{subject: path}``. A subject that cannot be opened fails the whole read.

    In streaming mode ``max_files`` and ``max_bytes`` bound what one micro-batch takes in; the rest
    waits in the source instead of being dropped.
    """
    for name, limit in (("max_files", max_files), ("max_bytes", max_bytes)):
        if limit is not None and limit <= 0:
            raise ValueError(f"{name} must be positive")
    frames = {}
    for subject, path in subjects.items():
        reader = spark.readStream if streaming else spark.read
        reader = reader.format(format).options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        if streaming:
            if schema is None:
                raise ValueError("a streaming input needs a schema")
            if max_files:
                reader = reader.option("maxFilesPerTrigger", max_files)
            if max_bytes:
                reader = reader.option("maxBytesPerTrigger", max_bytes)
        frames[subject] = reader.load(path)
    return union_subjects(frames)

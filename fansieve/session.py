"""Session helpers: reading the given tables, and intermediate tables that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table sent to every executor, by estimated row bytes.
BROADCAST_BYTES = 256 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Leave whole-stage code generation for conditions so wide that the JVM would not compile them."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def spread(df: DataFrame) -> DataFrame:
    """Cut a table that was read in fewer pieces than there are cores; leave larger ones as they are.

    Only for tables as read: it looks at the pieces of the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (``spark.checkpoint.dir``).

    Only a local session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fansieve-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The rows are fixed from here on: a lost executor re-reads them instead of recomputing them.
    """
    path = f"{shared_folder(df.sparkSession)}/fansieve/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame):
    """Estimated bytes of one row in memory, as a Column."""

    def width(col, kind):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit(16) + F.coalesce(F.octet_length(col), F.lit(0))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.lit(32) + F.coalesce(F.octet_length(F.to_json(F.struct(col.alias("x")))), F.lit(0)) * 2
        return F.lit(8)

    total = F.lit(16)
    for f in df.schema.fields:
        total = total + width(F.col(f"`{f.name}`"), f.dataType)
    return total.cast("long")


def table_bytes(df: DataFrame) -> int:
    """Estimated bytes of a whole table. Runs one aggregate; call it on a ``durable`` table."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0

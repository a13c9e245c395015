"""Topics as a table with a commit protocol: every batch arrives once, however often it was tried.

A batch is written to a folder of its own, in files that hold many topics each, sorted by topic, so that their number does not depend on how many topics there
are and a reader of a few topics skips most row groups. When all files are there, one manifest names the folder and the batch's counters; it is moved into
place in one step. Readers take the folders of manifests and nothing else: what a failed attempt left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "batch bigint, folder string, counters map<string,bigint>, ddl string"


class TopicTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch_id: int) -> bool:
        return self._files.exists(self._path(self._manifest(batch_id)))

    def _manifest(self, batch_id: int) -> str:
        return f"{self.path}/manifests/{batch_id:012d}.json"

    def write(self, rows: DataFrame, batch_id: int, counters: Callable[[DataFrame], dict[str, int]] | None = None) -> bool:
        """Add ``rows``, which have a ``topic``, as this batch. False if it is there already, from an attempt before.

        ``counters`` is given the rows as written; what it returns goes into the manifest.
        """
        if self.committed(batch_id):
            return False
        folder = f"{batch_id:012d}-{uuid.uuid4().hex}"
        # A heavy topic is cut over several tasks, small ones share one.
        spread = rows.hint("rebalance", F.col("topic")).sortWithinPartitions("topic")
        spread.write.parquet(f"{self.path}/data/{folder}")
        found = counters(self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{folder}")) if counters else {}
        self._commit(batch_id, {"batch": batch_id, "folder": folder, "counters": found, "ddl": rows.schema.json()})
        return True

    def _commit(self, batch_id: int, manifest: dict) -> None:
        waiting = self._path(f"{self.path}/uncommitted/{manifest['folder']}.json")
        out = self._files.create(waiting, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        final = self._path(self._manifest(batch_id))
        self._files.mkdirs(final.getParent())
        # A rename that finds another attempt's manifest fails, and that attempt counts.
        if not self._files.rename(waiting, final) and not self.committed(batch_id):
            raise OSError(f"could not commit batch {batch_id} to {self.path}")

    def manifests(self) -> DataFrame:
        """(batch, folder, counters) of every batch that has arrived."""
        schema = T._parse_datatype_string(MANIFEST)
        if not self._files.exists(self._path(f"{self.path}/manifests")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/manifests")

    def read(self, *topics: str) -> DataFrame:
        """All rows, or those of these topics, with their ``batch``."""
        listed = self.manifests().orderBy("batch").collect()
        if not listed:
            raise FileNotFoundError(f"no batch has arrived at {self.path}")
        schema = T.StructType.fromJson(json.loads(listed[-1]["ddl"]))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{m['folder']}" for m in listed))
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        rows = rows.select("*", F.split(folder, "-")[0].cast("bigint").alias("batch"))
        return rows.where(F.col("topic").isin(*topics)) if topics else rows

    def totals(self) -> DataFrame:
        """(counter, value): the counters of all batches that have arrived, each batch once."""
        each = self.manifests().select(F.explode("counters").alias("counter", "value"))
        return each.groupBy("counter").agg(F.sum("value").alias("value"))

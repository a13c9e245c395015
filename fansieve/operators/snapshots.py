"""Snapshots: what is held at a moment, so that later moments need only the log's tail.

A snapshot has one row per live hold, ``(sub_id, expression, client_id, ts, seq)`` with the request that keeps it alive, the moment ``as_of``
and the next id. Later requests are scanned together with these rows: all holds of a subscription are alive at ``as_of``, so they are
one incarnation, and it keeps its id; incarnations that begin in the tail are numbered on from ``next_id``.

``SnapshotStore`` keeps versions of it next to the log, each in a folder of its own that is complete before it is listed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.operators.leases import ORDER, live_leases, plus_ttl, timestamp
from fansieve.operators.match import with_topic
from fansieve.operators.ordered import lookup, numbered
from fansieve.operators.subscriptions import _summarise, _with_incarnation
from fansieve.session import durable

HOLDS = "sub_id bigint, expression string, client_id string, ts timestamp_ntz, seq bigint"
_COLUMNS = ["sub_id", "expression", "client_id", "ts", "seq"]
VERSIONS = "version string, as_of timestamp_ntz, next_id bigint"


@dataclass
class Snapshot:
    """``holds`` is a stored table; ``as_of`` is None before the first request."""

    holds: DataFrame
    next_id: int = 1
    as_of: datetime | None = None

    def active(self, output_prefix: str | None = None) -> DataFrame:
        """(sub_id, expression[, topic]) of what is active."""
        found = self.holds.select("sub_id", "expression").distinct()
        return with_topic(found, output_prefix) if output_prefix else found


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(spark.createDataFrame([], HOLDS))


def tail_of(log: DataFrame, snapshot: Snapshot, as_of) -> DataFrame:
    """The requests after the snapshot and up to ``as_of``: a condition on ``ts`` alone, which the scan takes."""
    tail = log.where(F.col("ts") <= timestamp(as_of))
    return tail if snapshot.as_of is None else tail.where(F.col("ts") > timestamp(snapshot.as_of))


def advance(snapshot: Snapshot, log: DataFrame, as_of, ttl: int) -> Snapshot:
    """The snapshot at ``as_of``, from an earlier one and the requests since. Requests carry their expression."""
    held = snapshot.holds.select(F.lit("sub").alias("op"), *_COLUMNS)
    tail = tail_of(log, snapshot, as_of).where(F.col("op").isin("sub", "unsub"))
    tail = tail.select("op", F.lit(None).cast("bigint").alias("sub_id"), *_COLUMNS[1:])
    rows = durable(_with_incarnation(held.unionByName(tail), ttl))
    kept = rows.where("sub_id IS NOT NULL").groupBy("expression", "incarnation").agg(F.max("sub_id").alias("sub_id"))
    every = durable(_summarise(rows).join(kept, ["expression", "incarnation"], "left"))
    new = every.where("sub_id IS NULL").drop("sub_id")
    new = durable(numbered(new, ["start_ts", "start_seq"], "sub_id", snapshot.next_id))
    last = new.agg(F.max("sub_id")).first()[0]
    alive = every.where("sub_id IS NOT NULL").unionByName(new).where(F.col("end_ts") > timestamp(as_of))
    alive = durable(alive.select("expression", "sub_id"))
    requests = rows.select("op", *_COLUMNS[1:])
    live = live_leases(requests, as_of, ttl).select("expression", "client_id", "ts", "seq")
    holds = lookup(live, alive, ["expression"], ["client_id"], "inner").select(*_COLUMNS)
    return Snapshot(durable(holds), snapshot.next_id if last is None else last + 1, _moment(snapshot.holds.sparkSession, as_of))


def _moment(spark: SparkSession, as_of) -> datetime:
    return as_of if isinstance(as_of, datetime) else spark.range(1).select(timestamp(as_of)).first()[0]


class SnapshotStore:
    """Versions of a snapshot under ``path``. A version is listed once its holds are written, so a failed writer leaves nothing that is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self) -> DataFrame | None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions") if there else None

    def latest(self, as_of=None) -> Snapshot:
        """The latest version, not after ``as_of``; an empty one if there is none. Of versions of one moment all say the same."""
        listed = self._listed()
        if listed is not None and as_of is not None:
            listed = listed.where(F.col("as_of") <= timestamp(as_of))
        row = None if listed is None else listed.orderBy(F.col("as_of").desc(), "version").first()
        if row is None:
            return empty(self.spark)
        holds = self.spark.read.schema(HOLDS).parquet(f"{self.path}/holds/{row['version']}")
        return Snapshot(holds, row["next_id"], row["as_of"])

    def save(self, snapshot: Snapshot) -> Snapshot:
        version = uuid.uuid4().hex
        snapshot.holds.select(*_COLUMNS).write.parquet(f"{self.path}/holds/{version}")
        listed = self.spark.createDataFrame([(version, snapshot.as_of, snapshot.next_id)], VERSIONS)
        listed.coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return self.latest(snapshot.as_of)

    def at(self, log: DataFrame, as_of, ttl: int) -> Snapshot:
        """The snapshot at ``as_of``: the last version before, brought forward by the log's tail, and saved."""
        base = self.latest(as_of)
        as_of = _moment(self.spark, as_of)
        return base if base.as_of == as_of else self.save(advance(base, log, as_of, ttl))


def expiring(snapshot: Snapshot, ttl: int) -> DataFrame:
    """The holds with the moment at which each ends unless it is refreshed."""
    return snapshot.holds.withColumn("expires", plus_ttl("ts", ttl))


__all__ = ["ORDER", "Snapshot", "SnapshotStore", "advance", "empty", "expiring", "tail_of"]

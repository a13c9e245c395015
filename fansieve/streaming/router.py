"""Matching and routing streams.

Every micro-batch reads one version of the subscriptions and is matched with the same code as a
batch. What it sends is committed with its counters in one step (see ``sources.topics``), and a batch that is retried
after that does nothing, so each event is routed and counted exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fansieve.operators.match import match, with_topic
from fansieve.operators.snapshots import SnapshotStore
from fansieve.operators.subscriptions import active_subscriptions
from fansieve.sources.topics import TopicTable

Snapshot = Callable[[SparkSession, DataFrame], DataFrame]


def log_snapshot(log_path: str, definitions: DataFrame, ttl: int, clock: Callable[[DataFrame], object]) -> Snapshot:
    """The subscriptions active at the time ``clock`` gives for a micro-batch, read from a control log.

    ``definitions`` maps expression texts to clauses.
    """

    def read(spark: SparkSession, batch: DataFrame) -> DataFrame:
        active = active_subscriptions(spark.read.parquet(log_path), clock(batch), ttl)
        return active.join(definitions.dropDuplicates(["expression"]), "expression")

    return read


def stored_snapshot(log_path: str, store_path: str, definitions: DataFrame, ttl: int, clock: Callable[[DataFrame], object]) -> Snapshot:
    """As ``log_snapshot``, but each micro-batch goes on from the last stored version and reads only the requests since.

    The log must be written to in order of time, as ``append_control_log`` does for a stream in order. A batch that is older than the last version is
    answered from the version before it.
    """

    def read(spark: SparkSession, batch: DataFrame) -> DataFrame:
        active = SnapshotStore(spark, store_path).at(spark.read.parquet(log_path), clock(batch), ttl).active()
        return active.join(definitions.dropDuplicates(["expression"]), "expression")

    return read


def latest_event_time(column: str = "ts") -> Callable[[DataFrame], object]:
    """A clock that follows the events: the newest event of the micro-batch."""
    return lambda batch: batch.agg(F.max(column)).first()[0]


def route_stream(
    events: DataFrame,
    snapshot: Snapshot,
    output_prefix: str,
    path: str,
    checkpoint: str,
    key: str = "event_id",
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start matching a stream and writing it as a ``TopicTable`` at ``path``.

    Counters per batch: received, matched (events with a match) and published (rows). ``key`` tells events apart.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        topics = TopicTable(spark, path)
        if topics.committed(batch_id):
            return
        # Read once for its size, the clock and the match.
        batch = batch.persist()
        try:
            received = batch.count()
            if not received:
                return
            subscriptions = with_topic(snapshot(spark, batch), output_prefix)
            matches = match(batch, subscriptions, key=(key,), **options)
            topics.write(matches, batch_id, lambda sent: {"received": received, "matched": sent.select(key).distinct().count(), "published": sent.count()})
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_control_log(requests: DataFrame, log_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start appending control requests to the log that ``log_snapshot`` reads."""
    writer = requests.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(log_path)


def window_counts(rows: DataFrame, counters: list[Column], time: str = "ts", every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counters per event-time window of a stream or a table.

    A watermark needs an instant, so a time without zone is read in the session time zone.
    """
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.window(time, every).alias("_w")).agg(*counters)
    return grouped.select(F.col("_w.start").alias("window_start"), *[c for c in grouped.columns if c != "_w"])

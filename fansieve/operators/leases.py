"""Leases: time-limited holds of a client on an expression.

The control log has the columns ``ts``, ``seq`` (breaks ties, unique), ``op`` (``'sub'`` or
``'unsub'``), ``client_id`` and ``expression``. A subscribe request creates or refreshes the lease,
an unsubscribe request ends it, and a lease that is not refreshed ends ``ttl`` seconds after its
last subscribe request, at that very moment.

Points in the log are ``struct(ts, seq, after)`` so that they compare in log order. An expiry has
``seq = -1``: it comes before every request of the same time.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.keys import parse_lease_key
from fansieve.operators.ordered import Laid, lay_out, pieces_for

LEASE = ("expression", "client_id")
ORDER = ("ts", "seq")
RECORD = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("subscription_id", T.LongType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("expression", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)


def point(ts: str = "ts", seq: str = "seq", after: int = 0) -> Column:
    return F.expr(f"named_struct('ts', {ts}, 'seq', CAST({seq} AS bigint), 'after', {after})")


def plus_ttl(ts: str, ttl: int) -> Column:
    if ttl <= 0:
        raise ValueError("the lease TTL must be positive")
    return F.expr(f"{ts} + INTERVAL {int(ttl)} SECONDS")


def timestamp(value) -> Column:
    """A moment given as text, datetime or Column; no time zone is applied."""
    if isinstance(value, Column):
        return value
    return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else value).cast("timestamp_ntz")


def current_leases(log: DataFrame, as_of=None, keys=LEASE) -> DataFrame:
    """The latest request of every lease key. Partial maxima keep heavy keys cheap."""
    rows = log if as_of is None else log.where(F.col("ts") <= timestamp(as_of))
    latest = F.max_by(F.struct("op", "ts", "seq"), F.struct(*ORDER)).alias("_last")
    return rows.groupBy(*keys).agg(latest).select(*keys, "_last.op", "_last.ts", "_last.seq")


def lease_status(log: DataFrame, as_of, ttl: int, keys=LEASE) -> DataFrame:
    """``current_leases`` with the expiry and a state: live, expired or deleted."""
    current = current_leases(log, as_of, keys).withColumn("expires", plus_ttl("ts", ttl))
    state = (
        F.when(F.col("op") == "unsub", "deleted").when(F.col("expires") > timestamp(as_of), "live").otherwise("expired")
    )
    return current.withColumn("state", state)


def live_leases(log: DataFrame, as_of, ttl: int, keys=LEASE) -> DataFrame:
    return lease_status(log, as_of, ttl, keys).where("state = 'live'").drop("state", "op")


def reconcile(held: DataFrame, live: DataFrame, keys=LEASE) -> DataFrame:
    """Held leases that the store no longer has: their holders are to be removed."""
    return held.select(*keys).distinct().join(live.select(*keys).distinct(), list(keys), "left_anti")


def with_lease_end(log: DataFrame, ttl: int, pieces: int) -> Laid:
    """Every request with ``lease_end``: where the hold it gives ends, NULL for unsubscribe requests.

    A hold that the client refreshes in time reaches just past the refresh, so that the two overlap.
    """
    laid = lay_out(log, LEASE, ORDER, pieces).next_row("_next", F.struct("ts", "seq", "op"))
    end = (
        F.when(F.col("op") != "sub", F.lit(None))
        .when(F.col("_next").isNull() | (F.col("_next.ts") >= F.col("_expires")), point("_expires", "-1"))
        .when(F.col("_next.op") == "sub", point("_next.ts", "_next.seq", 1))
        .otherwise(point("_next.ts", "_next.seq", 0))
    )
    laid = laid.with_column("_expires", plus_ttl("ts", ttl)).with_column("lease_end", end)
    return replace(laid, df=laid.df.drop("_next", "_expires"))


def lease_intervals(log: DataFrame, ttl: int) -> DataFrame:
    """[start, end) of every unbroken lease with the number of requests that kept it alive."""
    held = with_lease_end(log, ttl, pieces_for(log)).max_before("_held_to", F.col("lease_end"))
    starts = F.col("op").eqNullSafe("sub") & (F.col("_held_to").isNull() | (point() >= F.col("_held_to")))
    numbered = held.sum_through("lease_no", starts.cast("int")).rows()
    return (
        numbered.where("op = 'sub'")
        .groupBy(*LEASE, "lease_no")
        .agg(F.min("ts").alias("start_ts"), F.max("lease_end").alias("_end"), F.count("*").alias("requests"))
        .select(
            *LEASE,
            "lease_no",
            "start_ts",
            F.col("_end.ts").alias("end_ts"),
            F.when(F.col("_end.seq") < 0, "expired").otherwise("deleted").alias("ended_by"),
            "requests",
        )
    )


def latest_records(store: DataFrame, order: str = "created") -> DataFrame:
    """The current record of every key: a store keeps only the last one that was put or deleted. A record without a time is the newest."""
    rest = [c for c in store.columns if c not in ("key", order)]
    newest = F.max_by(F.struct(order, *rest), F.struct(F.col(order).isNull().alias("late"), order))
    return store.groupBy("key").agg(newest.alias("_last")).select("key", *(F.col(f"_last.{c}").alias(c) for c in store.columns if c != "key"))


def check_records(store: DataFrame) -> DataFrame:
    """Check stored lease records one by one: adds the parsed fields and ``reason`` (NULL if usable).

    ``store`` has ``key``, ``op`` (``'put'`` or a tombstone) and ``value``, the JSON record.
    """
    parsed = store.withColumn("_key", parse_lease_key("key")).withColumn("_record", F.from_json("value", RECORD))
    fields = F.col("_record")
    complete = (
        fields["version"].isNotNull()
        & fields["subscription_id"].isNotNull()
        & fields["client_id"].isNotNull()
        & fields["expression"].isNotNull()
    )
    same = (fields["subscription_id"] == F.col("_key.sub_id")) & (fields["client_id"] == F.col("_key.client_id"))
    reason = (
        F.when(F.col("_key").isNull(), "bad key")
        .when(F.col("op") != "put", "tombstone")
        .when(F.coalesce(fields["deleted"], F.lit(False)), "deleted")
        .when(~F.coalesce(complete, F.lit(False)), "bad record")
        .when((fields["version"] != 1) | ~same, "mismatch")
    )
    return parsed.select(
        *store.columns,
        F.col("_key.sub_id").cast("bigint").alias("sub_id"),
        F.col("_key.client_id").alias("client_id"),
        fields["expression"].alias("expression"),
        reason.alias("reason"),
    )

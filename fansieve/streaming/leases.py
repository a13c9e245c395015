"""Leases as keyed state of a stream: begun by a request, ended by a removal or by a timer.

Each (expression, client) keeps its lease: where it began, the last request, how many there were. A request sets the timer anew; if none comes, the timer fires
when the watermark has passed the end, and the expiry is emitted without any request. So a stream knows what is held from state alone, where
``log_snapshot`` reads the log again for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGES = "expression string, client_id string, at timestamp, change string, start timestamp, requests bigint"
#: Keyed state with timers needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeaseTimers(StatefulProcessor):
    def __init__(self, ttl: int):
        if ttl <= 0:
            raise ValueError("the lease TTL must be positive")
        # Moments are microseconds here, as in the log; timers have milliseconds, so they fire at the end or just after.
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "start bigint, last bigint, requests bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = sorted(r for some in rows for r in zip(some["micros"].tolist(), some["seq"].tolist(), some["op"].tolist(), strict=True))
        held = self.lease.get() if self.lease.exists() else None
        out = []
        for now, _, op in requests:
            if held and held[1] + self.ttl <= now:
                out.append((held[1] + self.ttl, "expired", held[0], held[2]))
                held = self._forget(held)
            if op == "sub":
                if held is None:
                    out.append((now, "begun", now, 1))
                held = (held[0] if held else now, now, held[2] + 1 if held else 1, held[3] if held else 0)
            elif held:
                out.append((now, "deleted", held[0], held[2]))
                held = self._forget(held)
        if held:
            timer = -(-(held[1] + self.ttl) // 1000)
            if timer != held[3]:
                if held[3]:
                    self.handle.deleteTimer(held[3])
                self.handle.registerTimer(timer)
            self.lease.update((held[0], held[1], held[2], timer))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.lease.exists():
            start, last, requests, _ = self.lease.get()
            self.lease.clear()
            yield self._rows(key, [(last + self.ttl, "expired", start, requests)])

    def close(self) -> None:
        pass

    def _forget(self, held) -> None:
        if held[3]:
            self.handle.deleteTimer(held[3])
        self.lease.clear()

    def _rows(self, key, out) -> pd.DataFrame:
        at, change, start, requests = zip(*out, strict=True)
        moments = {name: pd.to_datetime(pd.Series(values, dtype="int64"), unit="us") for name, values in (("at", at), ("start", start))}
        return pd.DataFrame({"expression": key[0], "client_id": key[1], "at": moments["at"], "change": change, "start": moments["start"], "requests": requests})


def lease_changes(requests: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """The stream ``requests(ts, seq, op, client_id, expression)`` as changes of what is held: begun, deleted, expired.

    ``requests`` tells how many requests kept the lease alive; ``start`` is where it began. A watermark needs an instant, so times without zone are read in the session
    time zone. A lease expires when the watermark, the newest request less ``late``, has reached its end; older requests are dropped.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = requests.where(F.col("op").isin("sub", "unsub")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    timed = timed.select("expression", "client_id", "op", F.col("seq").cast("bigint").alias("seq"), "ts", F.unix_micros("ts").alias("micros"))
    grouped = timed.groupBy("expression", "client_id")
    return grouped.transformWithStateInPandas(statefulProcessor=LeaseTimers(ttl), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def write_lease_changes(requests: DataFrame, ttl: int, path: str, checkpoint: str, late: str = "0 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Start appending the changes to a table at ``path``."""
    writer = lease_changes(requests, ttl, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)

"""Control messages from JSON to replies, with unsubscribe requests that name a subscription by its id.

Which subscription an id names depends on all requests before: an earlier removal lets an expression be asked for anew, which takes an id and shifts all
later ones. So the log is settled in order, ``CHUNK`` requests at a time. For each chunk Spark looks up, in the snapshot of what is held, the
subscriptions that the chunk can touch: those of its expressions and of the ids it names. For each that is the last moment at which a client
outside the chunk holds it, and one narrow row per client of the chunk. A task walks these bounded rows, which carry digests instead of texts, and says
for each request which id it has. The next snapshot is an aggregate over all holds again. Requests are settled exactly once, and what a
chunk needs does not grow with the log before it.

Requests have ``ts``, ``seq`` (unique), ``op``, ``client_id``, ``expression`` (of ``sub``) and ``id`` (of ``unsub``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fansieve.functions.keys import lease_key
from fansieve.operators.leases import plus_ttl
from fansieve.operators.match import with_topic
from fansieve.operators.ordered import lookup, numbered
from fansieve.operators.snapshots import Snapshot, empty
from fansieve.operators.subscriptions import control_log, error_replies
from fansieve.session import durable, shared_folder

#: Requests that are settled together, in one task.
CHUNK = 500_000

_WALKED = "seq bigint, key string, sub_id bigint, outcome string"


def _micros(ts: str) -> Column:
    """A moment without time zone as a number."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def _chunks(log: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """The requests with ``chunk``, stored so that each chunk is read alone; how many there are."""
    spark = log.sparkSession
    columns = ["ts", "seq", "op", "client_id", "expression", "id", *[c for c in log.columns if c == "reply_to"]]
    rows = log.where(F.col("op").isin("sub", "unsub")).select(*columns).withColumns({"key": F.md5(F.col("expression").cast("binary")), "who": F.md5(F.col("client_id").cast("binary"))})
    rows = numbered(rows, ["ts", "seq"], "place")
    rows = rows.withColumn("chunk", F.floor((F.col("place") - 1) / chunk).cast("int")).drop("place")
    path = f"{shared_folder(spark)}/fansieve/{uuid.uuid4().hex}"
    rows.write.partitionBy("chunk").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    last = stored.agg(F.max("chunk")).first()[0]
    return stored, 0 if last is None else last + 1


def _walk(next_id: int, ttl: int):
    """A task that settles requests in order, after the rows of what is held before them."""
    span = ttl * 1_000_000

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_id = next_id
        # By key: id, the last moment held by others, and of clients named here their moments. By id: its key.
        ids, others, holders, keys = {}, {}, {}, {}

        def until(key: str) -> int | None:
            ends = [*([others[key]] if others.get(key) is not None else []), *holders.get(key, {}).values()]
            return max(ends, default=None)

        for batch in batches:
            settled = []
            for late, op, key, who, number, now, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not late:
                    ids[key], keys[number] = number, key
                    if who is None:
                        others[key] = now
                    else:
                        holders.setdefault(key, {})[who] = now
                    continue
                if op == "sub":
                    end = until(key)
                    if end is None or end <= now:
                        ids[key], keys[new_id], others[key], holders[key] = new_id, key, None, {}
                        new_id += 1
                    holders.setdefault(key, {})[who] = now + span
                    settled.append((seq, key, ids[key], None))
                    continue
                key = keys.get(number)
                end = None if key is None or ids[key] != number else until(key)
                if end is None or end <= now:
                    settled.append((seq, None, None, "not_found"))
                    continue
                holders.get(key, {}).pop(who, None)
                end = until(key)
                outcome = "fully_removed" if end is None or end <= now else "still_active"
                if outcome == "fully_removed":
                    others[key], holders[key] = None, {}
                settled.append((seq, key, number, outcome))
            columns = zip(*settled, strict=True) if settled else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["seq", "key", "sub_id", "outcome"])

    return task


def _touched(rows: DataFrame, held: DataFrame, ttl: int) -> DataFrame:
    """The rows of the walk that say what is held: of a subscription's holders, those that these requests name by themselves, the others together."""
    named = F.broadcast(rows.where("op = 'unsub'").select(F.col("id").alias("sub_id")).distinct())
    by_id = held.join(named, "sub_id", "left_semi").select("key", "sub_id").distinct()
    pairs = rows.where("op = 'sub'").select("key", "who").unionByName(
        rows.where("op = 'unsub'").join(by_id.withColumnRenamed("key", "its_key"), F.col("id") == F.col("sub_id")).select(F.col("its_key").alias("key"), "who")
    )
    pairs = durable(pairs.distinct().withColumn("named", F.lit(True)))
    # At most one row per request: a bounded side.
    keys = F.broadcast(pairs.select("key").distinct())
    touched = held.join(keys, "key", "left_semi").join(F.broadcast(pairs), ["key", "who"], "left")
    end = _micros("expires")
    touched = touched.withColumn("expires", plus_ttl("ts", ttl)).groupBy("key", "sub_id", F.when(F.col("named"), F.col("who")).alias("who")).agg(F.max(end).alias("now"))
    return touched.select(F.lit(0).alias("late"), F.lit(None).cast("string").alias("op"), "key", "who", F.col("sub_id").alias("number"), "now", F.lit(None).cast("bigint").alias("seq"))


def settle(log: DataFrame, ttl: int, snapshot: Snapshot | None = None, chunk: int = CHUNK) -> tuple[DataFrame, Snapshot]:
    """The requests with the id each one has, and what is held after the last.

    Of other columns ``reply_to`` stays. Adds ``sub_id`` (of an unsubscribe request: if there was such a subscription), ``outcome`` (of unsubscribe requests: not_found, still_active or
    fully_removed) and ``key``, a digest of the expression. A removal by a client that holds nothing changes nothing. Requests that repeat a ``seq`` are not allowed;
    all must come after the snapshot. An empty log leaves the snapshot as it is.
    """
    spark = log.sparkSession
    snapshot = snapshot or empty(spark)
    stored, number = _chunks(log, chunk)
    done = []
    held = durable(snapshot.holds.withColumns({"key": F.md5(F.col("expression").cast("binary")), "who": F.md5(F.col("client_id").cast("binary"))}))
    next_id, as_of = snapshot.next_id, snapshot.as_of
    for k in range(number):
        rows = stored.where(F.col("chunk") == k).drop("chunk")
        asked = rows.select(
            F.lit(1).alias("late"), "op", F.when(F.col("op") == "sub", F.col("key")).alias("key"), "who", F.col("id").alias("number"), _micros("ts").alias("now"), "seq"
        )
        walked = _touched(rows, held, ttl).unionByName(asked).repartition(1).sortWithinPartitions("late", "now", "seq")
        walked = durable(walked.mapInArrow(_walk(next_id, ttl), _WALKED))
        told = rows.drop("key").join(F.broadcast(walked.withColumnRenamed("seq", "its_seq")), F.col("seq") == F.col("its_seq")).drop("its_seq")
        done.append(durable(told))
        last, as_of = done[-1].agg(F.max("sub_id"), F.max("ts")).first()
        next_id = max(next_id, (last or 0) + 1)
        # The last request of each client on each expression; refused removals are none.
        now = done[-1].where("op = 'sub' OR outcome <> 'not_found'").select("sub_id", "expression", "client_id", "ts", "seq", "key", "who", "op")
        every = held.withColumn("op", F.lit("sub")).unionByName(now)
        latest = every.groupBy("key", "who").agg(F.max_by(F.struct("sub_id", "expression", "client_id", "ts", "seq", "op"), F.struct("ts", "seq")).alias("last"))
        latest = latest.select("last.*", "key", "who").where((F.col("op") == "sub") & (plus_ttl("ts", ttl) > F.lit(as_of).cast("timestamp_ntz"))).drop("op")
        held = durable(latest)
    if not done:
        kind = "sub_id bigint, outcome string, key string"
        nothing = stored.drop("key", "who", "chunk").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in kind.split(", ")])
        return nothing, snapshot
    requests = done[0]
    for more in done[1:]:
        requests = requests.unionByName(more)
    return requests.drop("who"), Snapshot(held.drop("key", "who"), next_id, as_of)


def with_expression(requests: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
    """Settled requests whose removals also carry the expression that was meant."""
    known = requests.where("op = 'sub'").select("key", "expression")
    if snapshot is not None:
        known = known.unionByName(snapshot.holds.select(F.md5(F.col("expression").cast("binary")).alias("key"), "expression"))
    texts = durable(known.groupBy("key").agg(F.any_value("expression").alias("meant")))
    return lookup(requests, texts, ["key"], ["seq"]).withColumn("expression", F.coalesce("expression", "meant")).drop("meant")


def control_replies(messages: DataFrame, definitions: DataFrame, output_prefix: str, bucket: str, ttl: int, snapshot: Snapshot | None = None, chunk: int = CHUNK):
    """Every reply to ``messages(ts, seq, op, payload, reply_to)``, the settled requests, and what is held after them.

    ``definitions(expression, reason)`` has one row per known text, with what is wrong with it or null; a text that is not there cannot be subscribed to.
    A subscribe request without a reply address is ignored, an unsubscribe request without one is carried out. Replies: ``seq, reply_to, id,
    topic, lease_bucket, lease_key, lease_ttl_seconds, removed, error``, those that do not apply null. A message that cannot be read gets an error.
    """
    counts = (F.col("op") == "unsub") | ((F.col("op") == "sub") & F.col("reply_to").isNotNull())
    read = control_log(messages.where(counts))
    wrong = durable(read.where("error IS NOT NULL"))
    good = durable(read.where("error IS NULL").drop("error"))
    once = durable(definitions.groupBy("expression").agg(F.max("reason").alias("reason")).withColumn("known", F.lit(True)))
    checked = lookup(good, once, ["expression"], ["seq"])
    unknown = (F.col("op") == "sub") & F.col("known").isNull()
    checked = durable(checked.withColumn("reason", F.when(unknown, "unknown expression").when(F.col("op") == "sub", F.col("reason"))).drop("known"))
    requests, after = settle(checked.where("reason IS NULL").drop("reason"), ttl, snapshot, chunk)
    accepted = with_topic(requests.where("op = 'sub'"), output_prefix).select(
        "seq", "reply_to", F.col("sub_id").alias("id"), "topic", F.lit(bucket).alias("lease_bucket"), lease_key("sub_id", F.col("client_id")).alias("lease_key"),
        F.lit(ttl).cast("bigint").alias("lease_ttl_seconds"),
    )
    removed = requests.where("op = 'unsub' AND reply_to IS NOT NULL").select("seq", "reply_to", "id", (F.col("outcome") != "still_active").alias("removed"))
    invalid = checked.where("reason IS NOT NULL").select("seq", "reply_to", F.concat(F.lit("Invalid expression: "), "reason").alias("error"))
    bad = error_replies(wrong.where("reply_to IS NOT NULL")).join(wrong.select("seq", "reply_to"), "seq")
    out = accepted
    for more in (removed, invalid, bad):
        out = out.unionByName(more, allowMissingColumns=True)
    return out, requests, after

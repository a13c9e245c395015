"""Control messages that name subscriptions by id, snapshots with a tail, and leases of a stream, from messages made of the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fansieve.functions.predicates import invalid_reason
from fansieve.operators import control, snapshots, subscriptions
from fansieve.operators.ordered import lookup
from fansieve.operators.texts import parse_texts
from fansieve.plans.data import AS_OF, BUCKET, EVENT_ATTRIBUTES, PREFIX, TTL, definitions
from fansieve.plans.data import control as control_table
from fansieve.plans.subscriptions import ACTIVE, ISLANDS, VALID, valid_control
from fansieve.session import durable, shared_folder, table
from fansieve.streaming.leases import write_lease_changes

#: The moment of the stored snapshot that later ones begin from.
EARLIER = "2024-01-11 06:30:00"
#: Files that the log of the streamed leases comes in.
SLICES = 6

# Errors unsubscribe an id that is near those given by then: right, of others, stale or not yet given. Clicks are messages with faults.
_MESSAGES = """
    SELECT ts, event_id AS seq, CASE WHEN event_type = 'error' OR (event_type = 'click' AND value < 8) THEN 'unsub' ELSE 'sub' END AS op,
           concat('client-', CAST(user_id % 20 AS {text})) AS client_id,
           CASE WHEN event_type <> 'error' AND (event_type <> 'click' OR value >= 8) THEN
                CASE WHEN value >= 150 THEN concat('price > ', CAST(floor(value / 50) AS {int}))
                     ELSE concat('value > ', CAST(floor(value / 16) AS {int}), ' and user_id <> ', CAST(user_id % 9 AS {text})) END END AS expression,
           CAST(1 + (event_id * 7 + user_id) % (7 + floor(event_id / 9)) AS {int}) AS id,
           event_type = 'click' AND value < 12 AS faulty, CASE WHEN event_id % 13 <> 0 THEN concat('reply-', CAST(event_id AS {text})) END AS reply_to
    FROM events
"""
_JSON = """
    SELECT ts, seq, op, reply_to,
           CASE WHEN faulty AND seq % 3 = 0 THEN '{"client_id": '
                WHEN op = 'unsub' THEN concat('{"id": ', CASE WHEN faulty THEN '"x"' ELSE CAST(id AS {text}) END, ', "client_id": "', client_id, '"}')
                WHEN faulty THEN concat('{"expression": "', expression, '"}')
                ELSE concat('{"expression": "', expression, '", "client_id": "', client_id, '"}') END AS payload
    FROM ({messages}) m
"""
MESSAGES_SQL = _MESSAGES.replace("{text}", "varchar").replace("{int}", "bigint")

# One request after the other, with what is held: id, expression, client and end of every lease.
_SETTLED = f"""
    WITH RECURSIVE asked AS (
      SELECT *, row_number() OVER (ORDER BY ts, seq) AS n FROM ({MESSAGES_SQL}) m
      WHERE NOT faulty AND (op = 'unsub' OR (reply_to IS NOT NULL AND expression NOT LIKE 'price%'))),
    walk AS (
      SELECT CAST(0 AS bigint) AS n, CAST(0 AS bigint) AS seq, CAST(1 AS bigint) AS next_id, CAST(NULL AS bigint) AS sub_id, CAST(NULL AS varchar) AS outcome,
             CAST([] AS STRUCT(id bigint, e varchar, c varchar, "end" timestamp)[]) AS holds
      UNION ALL
      SELECT n, seq, CASE WHEN op = 'sub' AND mine IS NULL THEN next_id + 1 ELSE next_id END,
             CASE WHEN op = 'sub' THEN coalesce(mine, next_id) WHEN named > 0 THEN id END,
             CASE WHEN op = 'unsub' THEN CASE WHEN named = 0 THEN 'not_found' WHEN len(list_filter(kept, lambda h: h.id = id)) = 0 THEN 'fully_removed' ELSE 'still_active' END END,
             CASE WHEN op = 'unsub' THEN kept
                  ELSE list_append(kept, {{'id': coalesce(mine, next_id), 'e': expression, 'c': client_id, 'end': ts + INTERVAL {TTL} SECOND}}) END
      FROM (
        SELECT *, CASE WHEN op = 'sub' THEN list_filter(alive, lambda h: h.e = expression)[1].id END AS mine,
               len(list_filter(alive, lambda h: h.id = id)) AS named,
               list_filter(alive, lambda h: NOT (h.c = client_id AND CASE WHEN op = 'sub' THEN h.e = expression ELSE h.id = id END)) AS kept
        FROM (SELECT a.n, a.seq, a.op, a.ts, a.id, a.expression, a.client_id, w.next_id, list_filter(w.holds, lambda h: h."end" > a.ts) AS alive
              FROM walk w JOIN asked a ON a.n = w.n + 1) s) t)
"""


def _frame(spark, sf_dir, text):
    return spark.sql(text.replace("{text}", "string").replace("{int}", "bigint").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def _messages(spark, sf_dir):
    """The messages as JSON. Braces of the JSON text are doubled, as the text is a format."""
    rows = _frame(spark, sf_dir, _MESSAGES)
    text = _JSON.replace("{text}", "string").replace("{messages}", "<messages>").replace("{", "{{").replace("}", "}}").replace("(<messages>)", "{messages}")
    return spark.sql(text, messages=rows)


def _requests(spark, sf_dir):
    """The messages that can be carried out."""
    rows = _frame(spark, sf_dir, _MESSAGES)
    return rows.where("NOT faulty AND (op = 'unsub' OR (reply_to IS NOT NULL AND expression NOT LIKE 'price%'))")


def unsubscribe_by_id(spark, sf_dir):
    requests, _ = control.settle(_requests(spark, sf_dir), TTL)
    return requests.where("op = 'unsub'").select("seq", "id", "client_id", "sub_id", "outcome", (F.col("outcome") != "still_active").alias("removed"))


def _definitions(spark, sf_dir):
    """What is wrong with each text that clients may send, by the attribute schema."""
    return definitions(control_table(spark, sf_dir)).select("expression", invalid_reason(EVENT_ATTRIBUTES).alias("reason"))


def control_replies(spark, sf_dir):
    replies, _, _ = control.control_replies(_messages(spark, sf_dir), _definitions(spark, sf_dir), PREFIX, BUCKET, TTL)
    return replies


def assign_ids_to_texts(spark, sf_dir):
    """Ids of subscriptions of which only the texts are known: those that are no predicates over the attributes use up none."""
    log = control_table(spark, sf_dir).where("op IN ('sub', 'unsub')").select("ts", "seq", "op", "client_id", "expression")
    read = parse_texts(log, EVENT_ATTRIBUTES)
    good = durable(read.where("reason IS NULL").select("expression", F.lit(True).alias("good")))
    valid = lookup(log, good, ["expression"], ["seq"], "inner").drop("good")
    return subscriptions.assign_ids(subscriptions.incarnations(valid, TTL)).select("sub_id", "expression", "start_ts")


def snapshot_and_tail(spark, sf_dir):
    """What is active at a moment, from a stored snapshot of five days before and the requests since."""
    log = valid_control(spark, sf_dir)
    store = snapshots.SnapshotStore(spark, f"{shared_folder(spark)}/fansieve/{uuid.uuid4().hex}")
    store.at(log, EARLIER, TTL)
    return store.at(log, AS_OF, TTL).active(PREFIX)


def lease_changes_streamed(spark, sf_dir):
    """Leases begun, deleted and expired, by a stream that reads the log in several micro-batches and lets timers end leases.

    Up to the newest request: what expires later is not known to the stream yet.
    """
    folder = f"{shared_folder(spark)}/fansieve/{uuid.uuid4().hex}"
    log = valid_control(spark, sf_dir).select("ts", "seq", "op", "client_id", "expression")
    cuts = log.agg(F.percentile_approx(F.col("ts").cast("timestamp").cast("double"), [k / SLICES for k in range(1, SLICES)])).first()[0]
    seconds = F.col("ts").cast("timestamp").cast("double")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = log if low is None else log.where(seconds > low)
        part = part if high is None else part.where(seconds <= high)
        # One file after the other, as a log grows.
        part.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    write_lease_changes(stream, TTL, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/changes")
    return found.select("expression", "client_id", F.col("at").cast("timestamp_ntz").alias("at"), "change", F.col("start").cast("timestamp_ntz").alias("start"), "requests")


def queries():
    return {
        "unsubscribe_by_id": unsubscribe_by_id,
        "control_replies": control_replies,
        "assign_ids_to_texts": assign_ids_to_texts,
        "snapshot_and_tail": snapshot_and_tail,
        "lease_changes_streamed": lease_changes_streamed,
    }


def oracle_sql():
    heard = f"SELECT * FROM ({MESSAGES_SQL}) m WHERE op = 'unsub' OR reply_to IS NOT NULL"
    nothing = "CAST(NULL AS varchar)"
    # Bounds of every unbroken lease, and the requests that kept it.
    leases = f"""
        SELECT expression, client_id, min(ts) AS start, max(ts) + INTERVAL {TTL} SECOND AS until, count(*) AS requests, max(deleted) AS deleted
        FROM (
          SELECT *, sum(begins) OVER (PARTITION BY expression, client_id ORDER BY ts, seq) AS lease_no
          FROM (
            SELECT *, CASE WHEN pop IS NULL OR pop = 'unsub' OR pts + INTERVAL {TTL} SECOND <= ts THEN 1 ELSE 0 END AS begins,
                   CASE WHEN nop = 'unsub' AND nts < ts + INTERVAL {TTL} SECOND THEN nts END AS deleted
            FROM (SELECT *, lag(op) OVER w AS pop, lag(ts) OVER w AS pts, lead(op) OVER w AS nop, lead(ts) OVER w AS nts FROM ({VALID}) v
                  WINDOW w AS (PARTITION BY expression, client_id ORDER BY ts, seq)) a) b WHERE op = 'sub') c
        GROUP BY expression, client_id, lease_no"""
    return {
        "unsubscribe_by_id": f"""
            {_SETTLED} SELECT a.seq, a.id, a.client_id, w.sub_id, w.outcome, w.outcome <> 'still_active' AS removed
            FROM walk w JOIN asked a ON a.n = w.n WHERE a.op = 'unsub'""",
        "control_replies": f"""
            {_SETTLED}
            SELECT a.seq, a.reply_to, w.sub_id AS id, concat('{PREFIX}.', w.sub_id) AS topic, '{BUCKET}' AS lease_bucket,
                   concat(w.sub_id, '.', a.client_id) AS lease_key, CAST({TTL} AS bigint) AS lease_ttl_seconds, CAST(NULL AS boolean) AS removed, {nothing} AS error
            FROM walk w JOIN asked a ON a.n = w.n WHERE a.op = 'sub'
            UNION ALL
            SELECT a.seq, a.reply_to, a.id, NULL, NULL, NULL, NULL, w.outcome <> 'still_active', NULL
            FROM walk w JOIN asked a ON a.n = w.n WHERE a.op = 'unsub' AND a.reply_to IS NOT NULL
            UNION ALL
            SELECT seq, reply_to, NULL, NULL, NULL, NULL, NULL, NULL,
                   CASE WHEN NOT faulty THEN 'Invalid expression: unknown attribute: price' WHEN seq % 3 = 0 THEN 'Bad request: not JSON'
                        WHEN op = 'unsub' THEN 'Bad request: id' ELSE 'Bad request: client_id' END
            FROM ({heard}) h WHERE reply_to IS NOT NULL AND (faulty OR (op = 'sub' AND expression LIKE 'price%'))""",
        "assign_ids_to_texts": f"SELECT sub_id, expression, start_ts FROM ({ISLANDS}) i",
        "snapshot_and_tail": f"SELECT sub_id, expression, concat('{PREFIX}.', sub_id) AS topic FROM ({ACTIVE}) a",
        "lease_changes_streamed": f"""
            WITH leases AS ({leases}), newest AS (SELECT max(ts) AS ts FROM ({VALID}) v)
            SELECT expression, client_id, start AS at, 'begun' AS change, start, CAST(1 AS bigint) AS requests FROM leases
            UNION ALL SELECT expression, client_id, deleted, 'deleted', start, requests FROM leases WHERE deleted IS NOT NULL
            UNION ALL SELECT expression, client_id, until, 'expired', start, requests FROM leases, newest
                      WHERE deleted IS NULL AND until <= date_trunc('milliseconds', newest.ts)""",
    }

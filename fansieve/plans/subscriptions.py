"""Control messages, subscription maintenance and leases, from a control log made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fansieve.functions.keys import key_matches, lease_key, parse_lease_key
from fansieve.functions.predicates import clauses_of, invalid_reason
from fansieve.operators import leases, subscriptions
from fansieve.operators.leases import LEASE
from fansieve.operators.ordered import lookup
from fansieve.plans.data import AS_OF, BUCKET, CONTROL_SQL, EVENT_ATTRIBUTES, PREFIX, TTL, control
from fansieve.session import durable, table


def valid_control(spark, sf_dir):
    """The requests that can be carried out: subscriptions to known attributes only."""
    return subscriptions.split_invalid(control(spark, sf_dir), EVENT_ATTRIBUTES)[0]


# --- the same log and its history for the check -------------------------------------------------

VALID = f"SELECT * FROM ({CONTROL_SQL}) c WHERE (attribute = 'value' AND op = 'sub') OR op = 'unsub'"


def _history(log: str) -> str:
    """Requests with their hold's end, incarnation and outcome."""
    return f"""
    SELECT *, sum(CASE WHEN op = 'sub' AND (held IS NULL OR held <= {{'ts': ts, 'seq': seq, 'after': 0}}) THEN 1 ELSE 0 END)
                OVER (PARTITION BY expression ORDER BY ts, seq) AS incarnation,
           CASE WHEN op = 'unsub' THEN
             CASE WHEN held IS NULL OR held < {{'ts': ts, 'seq': seq, 'after': 0}} THEN 'not_found'
                  WHEN held = {{'ts': ts, 'seq': seq, 'after': 0}} THEN 'fully_removed' ELSE 'still_active' END END AS outcome
    FROM (
      SELECT *, max(hold) OVER (PARTITION BY expression ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
      FROM (
        SELECT *, CASE WHEN op = 'sub' THEN
                    CASE WHEN nts IS NULL OR nts >= ts + INTERVAL {TTL} SECOND THEN {{'ts': ts + INTERVAL {TTL} SECOND, 'seq': -1, 'after': 0}}
                         WHEN nop = 'sub' THEN {{'ts': nts, 'seq': nseq, 'after': 1}}
                         ELSE {{'ts': nts, 'seq': nseq, 'after': 0}} END END AS hold
        FROM (SELECT *, lead(ts) OVER w AS nts, lead(seq) OVER w AS nseq, lead(op) OVER w AS nop FROM ({log}) l
              WINDOW w AS (PARTITION BY expression, client_id ORDER BY ts, seq)) a) b) c"""


def _islands(log: str) -> str:
    return f"""
    SELECT *, row_number() OVER (ORDER BY start_ts, start_seq) AS sub_id
    FROM (SELECT expression, CAST(incarnation AS bigint) AS incarnation, min(ts) AS start_ts, min(seq) AS start_seq, max(hold).ts AS end_ts,
                 count(*) AS requests, count(DISTINCT client_id) AS clients
          FROM ({_history(log)}) h WHERE op = 'sub' GROUP BY expression, incarnation) i"""


HISTORY = _history(VALID)
ISLANDS = _islands(VALID)
SEEN = f"SELECT * FROM ({VALID}) v WHERE ts <= TIMESTAMP '{AS_OF}'"
ACTIVE = f"SELECT sub_id, expression FROM ({_islands(SEEN)}) i WHERE end_ts > TIMESTAMP '{AS_OF}'"
STATUS = f"""
    SELECT expression, client_id, ts, op, ts + INTERVAL {TTL} SECOND AS expires,
           CASE WHEN op = 'unsub' THEN 'deleted' WHEN ts + INTERVAL {TTL} SECOND > TIMESTAMP '{AS_OF}' THEN 'live' ELSE 'expired' END AS state
    FROM (SELECT *, row_number() OVER (PARTITION BY expression, client_id ORDER BY ts DESC, seq DESC) AS r FROM ({SEEN}) s) x WHERE r = 1"""


# --- requests -----------------------------------------------------------------------------------

_MESSAGES = """
    SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'unsub' ELSE 'sub' END AS op,
           CASE WHEN event_type = 'error' THEN
                  concat('{"id": ', CAST(user_id AS {text}), CASE WHEN value < 30 THEN '.5' ELSE '' END, ', "client_id": "c', CAST(user_id AS {text}), '"}')
                WHEN event_type = 'click' THEN concat('{"client_id": "c', CAST(user_id AS {text}), '"}')
                WHEN event_type = 'signup' AND value < 30 THEN '{"expression": "value > 1"'
                WHEN event_type = 'signup' THEN concat('{"expression": "value > ', CAST(user_id AS {text}), '"}')
                ELSE concat('{"expression": "value > ', CAST(user_id AS {text}), '", "client_id": "c', CAST(user_id AS {text}), '"}') END AS payload
    FROM events
"""


def _derived(spark, sf_dir, text):
    """The text over the events. Braces of the JSON in it are doubled, as the text is a format."""
    text = text.replace("{text}", "string").replace("{int}", "bigint").replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def control_log(spark, sf_dir):
    messages = _derived(spark, sf_dir, _MESSAGES)
    return subscriptions.control_log(messages).select("seq", "op", "expression", "client_id", "id", "error")


def dedupe_subscriptions(spark, sf_dir):
    return subscriptions.deduplicate(valid_control(spark, sf_dir)).drop("first_seq")


def subscription_islands(spark, sf_dir):
    return subscriptions.incarnations(valid_control(spark, sf_dir), TTL).drop("start_seq")


def assign_ids(spark, sf_dir):
    return subscriptions.assign_ids(subscriptions.incarnations(valid_control(spark, sf_dir), TTL)).select(
        "sub_id", "expression", "start_ts"
    )


def next_id(spark, sf_dir):
    return subscriptions.next_id(subscriptions.assign_ids(subscriptions.incarnations(valid_control(spark, sf_dir), TTL)))


def active_snapshot(spark, sf_dir):
    return subscriptions.active_subscriptions(valid_control(spark, sf_dir), AS_OF, TTL, PREFIX)


def active_count(spark, sf_dir):
    return subscriptions.active_subscriptions(valid_control(spark, sf_dir), AS_OF, TTL).agg(F.count("*").alias("active"))


def subscription_holders(spark, sf_dir):
    return subscriptions.holders(valid_control(spark, sf_dir), AS_OF, TTL)


def remove_lease_outcome(spark, sf_dir):
    done = subscriptions.history(valid_control(spark, sf_dir), TTL)
    return done.requests.where("op = 'unsub'").select("seq", "expression", "client_id", "sub_id", "outcome")


def subscribe_replies(spark, sf_dir):
    valid, rejected = subscriptions.split_invalid(subscriptions.heard(control(spark, sf_dir)), EVENT_ATTRIBUTES)
    done = subscriptions.history(valid, TTL)
    return subscriptions.subscribe_replies(done.requests, rejected, PREFIX, BUCKET, TTL)


def unsubscribe_replies(spark, sf_dir):
    done = subscriptions.history(valid_control(spark, sf_dir), TTL)
    return subscriptions.unsubscribe_replies(done.requests)


def ignore_no_reply(spark, sf_dir):
    return subscriptions.heard(control(spark, sf_dir)).select("seq", "op", "reply_to")


def lookup_by_id(spark, sf_dir):
    active = durable(subscriptions.active_subscriptions(valid_control(spark, sf_dir), AS_OF, TTL))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sub_id"))
    return lookup(asked, active, ["sub_id"], ["sub_id"]).select("sub_id", "expression")


def lookup_by_expression(spark, sf_dir):
    log = valid_control(spark, sf_dir)
    active = durable(subscriptions.active_subscriptions(log, AS_OF, TTL))
    asked = log.select("expression").distinct()
    return lookup(asked, active, ["expression"], ["expression"]).select("expression", "sub_id")


def force_remove(spark, sf_dir):
    active = durable(subscriptions.active_subscriptions(valid_control(spark, sf_dir), AS_OF, TTL))
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("sub_id"))
    left = subscriptions.force_remove(active, ids).select("sub_id", F.lit(None).cast("boolean").alias("removed"))
    return subscriptions.force_remove_results(active, ids).unionByName(left)


# --- leases -------------------------------------------------------------------------------------


def lease_keys(spark, sf_dir):
    """Every lease key there and back, with some that are not valid."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("CASE WHEN c_acctbal < 0 THEN concat(c_name, '.x') WHEN c_mktsegment = 'MACHINERY' THEN concat(CAST(c_custkey AS string), '.') END").alias("odd"),
        lease_key("c_custkey", F.concat("c_mktsegment", F.lit(".node-"), F.col("c_nationkey"))).alias("made"),
    )
    rows = rows.withColumn("key", F.coalesce("odd", "made")).withColumn("parsed", parse_lease_key("key"))
    return rows.select("key", F.col("parsed.sub_id").cast("bigint").alias("sub_id"), F.col("parsed.client_id").alias("client_id"))


def lease_current(spark, sf_dir):
    return leases.lease_status(valid_control(spark, sf_dir), AS_OF, TTL).select(*LEASE, "op", "ts", "state")


def lease_expired(spark, sf_dir):
    rows = leases.lease_status(valid_control(spark, sf_dir), AS_OF, TTL).where("state = 'expired'")
    return rows.select(*LEASE, "expires")


def lease_reconcile(spark, sf_dir):
    log = valid_control(spark, sf_dir)
    held = leases.current_leases(log.where("op = 'sub'"), AS_OF)
    return leases.reconcile(held, leases.live_leases(log, AS_OF, TTL))


def lease_intervals(spark, sf_dir):
    rows = leases.lease_intervals(valid_control(spark, sf_dir), TTL)
    return rows.select(*LEASE, "start_ts", "end_ts", "ended_by", "requests")


_STORE = """
    SELECT concat(CASE WHEN event_type = 'view' AND value < 20 THEN 'x' ELSE '' END, CAST(user_id AS {text}), '.c', CAST(event_id % 17 AS {text})) AS key,
           CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op,
           concat('{"version": ', CASE WHEN event_type = 'click' AND value < 20 THEN '2' ELSE '1' END,
                  CASE WHEN event_type = 'signup' AND value > 60 THEN ', "deleted": true' ELSE '' END,
                  CASE WHEN event_type = 'signup' AND value < 15 THEN '' ELSE concat(', "subscription_id": ', CAST(user_id AS {text})) END,
                  ', "client_id": "c', CAST(CASE WHEN event_type = 'purchase' AND value < 15 THEN 99 ELSE event_id % 17 END AS {text}),
                  '", "expression": "', CASE WHEN event_type = 'purchase' AND value > 90 THEN 'price' ELSE 'value' END, ' > ',
                  CAST(CASE WHEN value < 45 THEN user_id ELSE CAST(floor(value) AS {int}) END AS {text}), '"}') AS value,
           event_id AS created, CASE WHEN event_type = 'purchase' AND value > 90 THEN 'price' ELSE 'value' END AS attribute,
           CASE WHEN value < 45 THEN user_id ELSE CAST(floor(value) AS {int}) END AS threshold
    FROM events
"""


def _store(spark, sf_dir):
    return _derived(spark, sf_dir, _STORE)


def _checked(spark, sf_dir):
    """The current record of every key, with what is wrong with it: the record, or its predicate by the attribute schema."""
    latest = leases.latest_records(_store(spark, sf_dir))
    watched = F.when(F.col("attribute") == "price", clauses_of([("price", ">", "threshold", "float")])).otherwise(clauses_of([("value", ">", "threshold", "float")]))
    checked = leases.check_records(latest).withColumn("clauses", watched)
    wrong = F.col("reason").isNull() & invalid_reason(EVENT_ATTRIBUTES).isNotNull()
    return checked.withColumn("reason", F.when(wrong, "invalid expression").otherwise(F.col("reason"))).drop("clauses")


def restore_conflicts(spark, sf_dir):
    good = durable(_checked(spark, sf_dir).where("reason IS NULL").select("key", "sub_id", "expression", "created"))
    return subscriptions.restore_conflicts(good).select("created", "sub_id", "expression", "restored")


def restore_validate(spark, sf_dir):
    checked = durable(_checked(spark, sf_dir))
    good = checked.where("reason IS NULL").select("key", "sub_id", "expression", "created")
    decided = subscriptions.restore_conflicts(good)
    conflict = F.when(~F.col("restored"), "conflict").alias("reason")
    return checked.where("reason IS NOT NULL").select("created", "reason").unionByName(decided.select("created", conflict))


# Records one after the other, with what is bound so far.
_DECIDED = f"""
    WITH RECURSIVE store AS ({_STORE.replace("{text}", "varchar").replace("{int}", "bigint")}),
    latest AS (SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY key ORDER BY created DESC) = 1),
    parsed AS (SELECT *, CAST(value AS json) AS j, regexp_matches(key, '^[0-9]+\\..+') AS key_ok FROM latest),
    checked AS (
      SELECT created, key, CAST(j->>'subscription_id' AS bigint) AS sub_id, j->>'expression' AS expression,
             CASE WHEN NOT key_ok THEN 'bad key' WHEN op <> 'put' THEN 'tombstone'
                  WHEN coalesce(CAST(j->>'deleted' AS boolean), false) THEN 'deleted'
                  WHEN j->>'subscription_id' IS NULL THEN 'bad record'
                  WHEN j->>'version' <> '1' OR concat(j->>'subscription_id', '.', j->>'client_id') <> key THEN 'mismatch'
                  WHEN j->>'expression' NOT LIKE 'value%' THEN 'invalid expression' END AS reason
      FROM parsed),
    pairs AS (SELECT sub_id, expression, row_number() OVER (ORDER BY min(created)) AS n FROM checked WHERE reason IS NULL GROUP BY sub_id, expression),
    walk AS (
      SELECT CAST(0 AS bigint) AS n, CAST([] AS bigint[]) AS ids, CAST([] AS varchar[]) AS texts, false AS won
      UNION ALL
      SELECT p.n,
             CASE WHEN list_contains(w.ids, p.sub_id) OR list_contains(w.texts, p.expression) THEN w.ids ELSE list_append(w.ids, p.sub_id) END,
             CASE WHEN list_contains(w.ids, p.sub_id) OR list_contains(w.texts, p.expression) THEN w.texts ELSE list_append(w.texts, p.expression) END,
             NOT (list_contains(w.ids, p.sub_id) OR list_contains(w.texts, p.expression))
      FROM walk w JOIN pairs p ON p.n = w.n + 1),
    bound AS (SELECT p.sub_id, p.expression FROM walk w JOIN pairs p ON p.n = w.n WHERE w.won)
"""


def key_pattern(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.concat_ws(".", "c_mktsegment", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("key")
    )
    return rows.select(
        "key",
        key_matches("key", "*.7.*").alias("one_token"),
        key_matches("key", "MACHINERY.>").alias("rest"),
        key_matches("key", "*.*").alias("two_tokens"),
    )


def queries():
    return {
        "control_log": control_log,
        "dedupe_subscriptions": dedupe_subscriptions,
        "subscription_islands": subscription_islands,
        "assign_ids": assign_ids,
        "next_id": next_id,
        "active_snapshot": active_snapshot,
        "active_count": active_count,
        "subscription_holders": subscription_holders,
        "remove_lease_outcome": remove_lease_outcome,
        "subscribe_replies": subscribe_replies,
        "unsubscribe_replies": unsubscribe_replies,
        "ignore_no_reply": ignore_no_reply,
        "lookup_by_id": lookup_by_id,
        "lookup_by_expression": lookup_by_expression,
        "force_remove": force_remove,
        "lease_key": lease_keys,
        "lease_current": lease_current,
        "lease_expired": lease_expired,
        "lease_reconcile": lease_reconcile,
        "lease_intervals": lease_intervals,
        "restore_conflicts": restore_conflicts,
        "restore_validate": restore_validate,
        "key_pattern": key_pattern,
    }


def oracle_sql():
    heard = f"SELECT * FROM ({CONTROL_SQL}) c WHERE op = 'unsub' OR (op = 'sub' AND reply_to IS NOT NULL)"
    heard_valid = f"SELECT * FROM ({heard}) c WHERE attribute = 'value' OR op = 'unsub'"
    return {
        "control_log": f"""
            SELECT seq, op, j->>'expression' AS expression, j->>'client_id' AS client_id,
                   CASE WHEN json_type(j, '$.id') IN ('BIGINT', 'UBIGINT') THEN CAST(j->>'id' AS bigint) END AS id,
                   CASE WHEN j IS NULL THEN 'Bad request: not JSON'
                        WHEN op = 'sub' AND j->>'expression' IS NULL THEN 'Bad request: expression'
                        WHEN op = 'unsub' AND json_type(j, '$.id') NOT IN ('BIGINT', 'UBIGINT') THEN 'Bad request: id'
                        WHEN j->>'client_id' IS NULL THEN 'Bad request: client_id' END AS error
            FROM (SELECT *, TRY_CAST(payload AS json) AS j FROM ({_MESSAGES.replace("{text}", "varchar")}) m) p""",
        "dedupe_subscriptions": f"""
            SELECT expression, min(ts) AS first_ts, count(*) AS requests, count(DISTINCT client_id) AS clients
            FROM ({VALID}) v WHERE op = 'sub' GROUP BY expression""",
        "subscription_islands": f"SELECT expression, incarnation, start_ts, end_ts, requests, clients FROM ({ISLANDS}) i",
        "assign_ids": f"SELECT sub_id, expression, start_ts FROM ({ISLANDS}) i",
        "next_id": f"SELECT count(*) + 1 AS next_id FROM ({ISLANDS}) i",
        "active_snapshot": f"SELECT sub_id, expression, concat('{PREFIX}.', sub_id) AS topic FROM ({ACTIVE}) a",
        "active_count": f"SELECT count(*) AS active FROM ({ACTIVE}) a",
        "subscription_holders": f"SELECT a.sub_id, a.expression, s.client_id FROM ({ACTIVE}) a JOIN ({STATUS}) s ON s.expression = a.expression AND s.state = 'live'",
        "remove_lease_outcome": f"""
            SELECT h.seq, h.expression, h.client_id, i.sub_id, h.outcome FROM ({HISTORY}) h
            LEFT JOIN ({ISLANDS}) i ON i.expression = h.expression AND i.incarnation = h.incarnation AND h.outcome <> 'not_found'
            WHERE h.op = 'unsub'""",
        "subscribe_replies": f"""
            SELECT h.seq, i.sub_id AS id, concat('{PREFIX}.', i.sub_id) AS topic, '{BUCKET}' AS lease_bucket,
                   concat(i.sub_id, '.', h.client_id) AS lease_key, CAST({TTL} AS bigint) AS lease_ttl_seconds, CAST(NULL AS varchar) AS error
            FROM ({_history(heard_valid)}) h JOIN ({_islands(heard_valid)}) i ON i.expression = h.expression AND i.incarnation = h.incarnation
            WHERE h.op = 'sub'
            UNION ALL
            SELECT seq, NULL, NULL, NULL, NULL, NULL, 'Invalid expression: unknown attribute: price' FROM ({heard}) c
            WHERE op = 'sub' AND attribute = 'price'""",
        "unsubscribe_replies": f"""
            SELECT h.seq, i.sub_id AS id, h.outcome <> 'still_active' AS removed FROM ({HISTORY}) h
            LEFT JOIN ({ISLANDS}) i ON i.expression = h.expression AND i.incarnation = h.incarnation AND h.outcome <> 'not_found'
            WHERE h.op = 'unsub'""",
        "ignore_no_reply": f"SELECT seq, op, reply_to FROM ({heard}) h",
        "lookup_by_id": f"SELECT c_custkey AS sub_id, a.expression FROM customer LEFT JOIN ({ACTIVE}) a ON a.sub_id = c_custkey",
        "lookup_by_expression": f"""
            SELECT v.expression, a.sub_id FROM (SELECT DISTINCT expression FROM ({VALID}) x) v LEFT JOIN ({ACTIVE}) a ON a.expression = v.expression""",
        "force_remove": f"""
            WITH active AS ({ACTIVE}), ids AS (SELECT DISTINCT o_custkey AS sub_id FROM orders WHERE o_orderpriority = '1-URGENT')
            SELECT sub_id, sub_id IN (SELECT sub_id FROM active) AS removed FROM ids
            UNION ALL SELECT sub_id, CAST(NULL AS boolean) FROM active WHERE sub_id NOT IN (SELECT sub_id FROM ids)""",
        "lease_key": """
            SELECT CASE WHEN c_acctbal < 0 THEN concat(c_name, '.x') WHEN c_mktsegment = 'MACHINERY' THEN concat(c_custkey, '.')
                        ELSE concat(c_custkey, '.', c_mktsegment, '.node-', c_nationkey) END AS key,
                   CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' THEN c_custkey END AS sub_id,
                   CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' THEN concat(c_mktsegment, '.node-', c_nationkey) END AS client_id
            FROM customer""",
        "lease_current": f"SELECT expression, client_id, op, ts, state FROM ({STATUS}) s",
        "lease_expired": f"SELECT expression, client_id, expires FROM ({STATUS}) s WHERE state = 'expired'",
        "lease_reconcile": f"""
            SELECT DISTINCT expression, client_id FROM ({SEEN}) s WHERE op = 'sub'
            EXCEPT SELECT expression, client_id FROM ({STATUS}) s WHERE state = 'live'""",
        "lease_intervals": f"""
            SELECT expression, client_id, min(ts) AS start_ts, max(hold).ts AS end_ts,
                   CASE WHEN max(hold).seq < 0 THEN 'expired' ELSE 'deleted' END AS ended_by, count(*) AS requests
            FROM (
              SELECT *, sum(CASE WHEN op = 'sub' AND (before IS NULL OR before <= {{'ts': ts, 'seq': seq, 'after': 0}}) THEN 1 ELSE 0 END)
                          OVER (PARTITION BY expression, client_id ORDER BY ts, seq) AS lease_no
              FROM (SELECT *, max(hold) OVER (PARTITION BY expression, client_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                    FROM ({HISTORY}) h) g) f
            WHERE op = 'sub' GROUP BY expression, client_id, lease_no""",
        "restore_conflicts": f"""
            {_DECIDED} SELECT c.created, c.sub_id, c.expression, b.sub_id IS NOT NULL AS restored FROM checked c
            LEFT JOIN bound b ON b.sub_id = c.sub_id AND b.expression = c.expression WHERE c.reason IS NULL""",
        "restore_validate": f"""
            {_DECIDED} SELECT c.created, coalesce(c.reason, CASE WHEN b.sub_id IS NULL THEN 'conflict' END) AS reason FROM checked c
            LEFT JOIN bound b ON b.sub_id = c.sub_id AND b.expression = c.expression AND c.reason IS NULL""",
        "key_pattern": """
            SELECT concat(c_mktsegment, '.', c_nationkey, '.', c_custkey) AS key, c_nationkey = 7 AS one_token,
                   c_mktsegment = 'MACHINERY' AS rest, false AS two_tokens FROM customer""",
    }

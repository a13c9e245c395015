"""Inputs, payload decoding and routing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fansieve.functions.attributes import attribute_schema
from fansieve.operators.decode import decode_payloads, parse_payload, skip_empty, typed_events, within_size
from fansieve.operators.match import fan_out
from fansieve.plans.data import EVENT_ATTRIBUTES, EVENTS, PAYLOAD_SCHEMA, PAYLOADS, PREFIX, events, payloads
from fansieve.plans.matching import MATCH_ALL, subscription_table
from fansieve.plans.predicates import ON_EVENTS
from fansieve.session import shared_folder, table
from fansieve.sources.inputs import union_subjects
from fansieve.sources.topics import TopicTable

MAX_BYTES = 110


def _decoded(spark, sf_dir):
    return decode_payloads(payloads(spark, sf_dir), PAYLOAD_SCHEMA)


def multi_subject_input(spark, sf_dir):
    """Two subjects with one attribute schema."""
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_acctbal AS balance")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS balance")
    return union_subjects({"customer": customers, "supplier": suppliers})


def skip_empty_payload(spark, sf_dir):
    return skip_empty(payloads(spark, sf_dir)).select("event_id", "payload")


def oversize_reject(spark, sf_dir):
    return within_size(payloads(spark, sf_dir), MAX_BYTES).select("event_id", "payload")


def decode_payload(spark, sf_dir):
    return _decoded(spark, sf_dir).select("event_id", "decodable", "value", "temperature", "active", "location")


def decode_props(spark, sf_dir):
    """The JSON column of the events as it is given."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    return decode_payloads(rows, attribute_schema(["k:int"])).select("event_id", "decodable", "k")


def reject_non_map(spark, sf_dir):
    parsed = parse_payload(payloads(spark, sf_dir)).where("body IS NOT NULL")
    return parsed.select("event_id", "event_type")


def project_schema(spark, sf_dir):
    rows = parse_payload(payloads(spark, sf_dir))
    return typed_events(rows, PAYLOAD_SCHEMA, keep=["event_id"]).select("event_id", "location", "temperature")


def extract_types(spark, sf_dir):
    return _decoded(spark, sf_dir).where("decodable").select("event_id", "value", "temperature", "active", "location")


def extract_lists(spark, sf_dir):
    rows = _decoded(spark, sf_dir).where("decodable")
    return rows.select(
        "event_id",
        F.array_join("tags", ",").alias("tags"),
        F.size("tags").cast("bigint").alias("n_tags"),
        F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"),
        F.array_size("scores").cast("bigint").alias("n_scores"),
    ).withColumn("n_tags", F.expr("CASE WHEN tags IS NOT NULL THEN n_tags END"))


def type_mismatch_undefined(spark, sf_dir):
    """How often each attribute is undefined, by kind of message."""
    rows = _decoded(spark, sf_dir).where("decodable")
    undefined = [F.count_if(F.col(a).isNull()).alias(f"undefined_{a}") for a in PAYLOAD_SCHEMA.names]
    return rows.groupBy("event_type").agg(F.count("*").alias("messages"), *undefined)


def missing_key_undefined(spark, sf_dir):
    return _decoded(spark, sf_dir).where("decodable AND value IS NULL").select("event_id", "event_type")


def route_to_topic(spark, sf_dir):
    """Route through the topic sink and read back what arrived, by topic."""
    path = f"{shared_folder(spark)}/fansieve/routed-{uuid.uuid4().hex}"
    subscriptions = subscription_table(spark, [p for p, _ in ON_EVENTS.values()])
    matches = fan_out(events(spark, sf_dir), subscriptions, PREFIX, attributes=EVENT_ATTRIBUTES)
    topics = TopicTable(spark, path)
    topics.write(matches.select("event_id", "value", "topic"), 0)
    return topics.read().groupBy("topic").agg(
        F.count("*").alias("records"), F.min("event_id").alias("first_event"), F.max("value").alias("largest")
    )


_J = f"(SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS body FROM (SELECT *, TRY_CAST(payload AS json) AS j FROM ({PAYLOADS}) p WHERE payload <> '') q)"
_INT = "json_type(body, '$.value') IN ('BIGINT', 'UBIGINT')"
_TYPED = f"""
    SELECT event_id, event_type, body IS NOT NULL AS decodable,
           CASE WHEN {_INT} THEN CAST(body->>'value' AS bigint) END AS value,
           CASE WHEN json_type(body, '$.temperature') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(body->>'temperature' AS double) END AS temperature,
           CASE WHEN json_type(body, '$.active') = 'BOOLEAN' THEN CAST(body->>'active' AS boolean) END AS active,
           CASE WHEN json_type(body, '$.location') = 'VARCHAR' THEN body->>'location' END AS location,
           CASE WHEN json_type(body, '$.tags') = 'ARRAY' THEN
             list_transform(list_filter(CAST(body->'tags' AS json[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') END AS tags,
           CASE WHEN json_type(body, '$.scores') = 'ARRAY' THEN
             list_transform(list_filter(CAST(body->'scores' AS json[]), lambda x: json_type(x) IN ('BIGINT', 'UBIGINT')), lambda x: x->>'$') END AS scores
    FROM {_J} j
"""


def queries():
    return {
        "multi_subject_input": multi_subject_input,
        "skip_empty_payload": skip_empty_payload,
        "oversize_reject": oversize_reject,
        "decode_payload": decode_payload,
        "decode_props": decode_props,
        "reject_non_map": reject_non_map,
        "project_schema": project_schema,
        "extract_types": extract_types,
        "extract_lists": extract_lists,
        "type_mismatch_undefined": type_mismatch_undefined,
        "missing_key_undefined": missing_key_undefined,
        "route_to_topic": route_to_topic,
    }


def oracle_sql():
    counts = ", ".join(f"count(*) FILTER (WHERE {a} IS NULL) AS undefined_{a}" for a in PAYLOAD_SCHEMA.names)
    return {
        "multi_subject_input": """
            SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS subject FROM customer
            UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'supplier' FROM supplier""",
        "skip_empty_payload": f"SELECT event_id, payload FROM ({PAYLOADS}) p WHERE payload <> ''",
        "oversize_reject": f"SELECT event_id, payload FROM ({PAYLOADS}) p WHERE octet_length(encode(payload)) <= {MAX_BYTES}",
        "decode_payload": f"SELECT event_id, decodable, value, temperature, active, location FROM ({_TYPED}) t",
        "decode_props": """
            SELECT event_id, coalesce(json_type(j), '') = 'OBJECT' AS decodable,
                   CASE WHEN json_type(j, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(j->>'k' AS bigint) END AS k
            FROM (SELECT event_id, TRY_CAST(props AS json) AS j FROM events) e""",
        "reject_non_map": f"SELECT event_id, event_type FROM ({_TYPED}) t WHERE decodable",
        "project_schema": f"""
            SELECT p.event_id, t.location, t.temperature FROM ({PAYLOADS}) p LEFT JOIN ({_TYPED}) t ON t.event_id = p.event_id""",
        "extract_types": f"SELECT event_id, value, temperature, active, location FROM ({_TYPED}) t WHERE decodable",
        "extract_lists": f"""
            SELECT event_id, array_to_string(tags, ',') AS tags, len(tags) AS n_tags, array_to_string(scores, ',') AS scores, len(scores) AS n_scores
            FROM ({_TYPED}) t WHERE decodable""",
        "type_mismatch_undefined": f"SELECT event_type, count(*) AS messages, {counts} FROM ({_TYPED}) t WHERE decodable GROUP BY event_type",
        "missing_key_undefined": f"SELECT event_id, event_type FROM ({_TYPED}) t WHERE decodable AND value IS NULL",
        "route_to_topic": f"""
            SELECT concat('{PREFIX}.', m.sub_id) AS topic, count(*) AS records, min(m.event_id) AS first_event, max(e.value) AS largest
            FROM ({MATCH_ALL}) m JOIN ({EVENTS}) e ON e.event_id = m.event_id GROUP BY m.sub_id""",
    }


TYPED = _TYPED

"""Typed events, payloads, subscriptions and control requests derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.functions.attributes import attribute_schema
from fansieve.functions.predicates import clauses_of
from fansieve.operators.ordered import numbered
from fansieve.session import spread, table

TTL = 24 * 3600  # seconds a lease lives in the example control log
AS_OF = "2024-01-16 12:00:00"
PREFIX = "alerts.out"
BUCKET = "holds"

EVENT_ATTRIBUTES = {"user_id": "integer", "event_type": "string", "value": "float", "flag": "boolean"}
# Undefined values: every seventh value and every fifth type are NULL.
EVENT_COLUMNS = (
    "event_id",
    "ts",
    "CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id",
    "CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type",
    "CASE WHEN event_id % 7 <> 0 THEN value END AS value",
    "CASE WHEN event_id % 3 <> 0 THEN value > 50 END AS flag",
)
EVENTS = f"SELECT {', '.join(EVENT_COLUMNS)} FROM events"

ORDER_ATTRIBUTES = {"flags": "string_list", "numbers": "integer_list", "suppliers": "integer_list", "revenue": "float"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")).selectExpr(*EVENT_COLUMNS)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order with list attributes. An order has at most a handful of lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(
        F.expr("array_sort(collect_set(l_returnflag))").alias("flags"),
        F.expr("array_sort(collect_list(CAST(l_linenumber AS bigint)) FILTER (WHERE l_quantity > 25))").alias("numbers"),
        F.expr("array_sort(collect_set(l_suppkey))").alias("suppliers"),
        F.expr("CASE WHEN l_orderkey % 9 <> 0 THEN sum(CAST(l_extendedprice AS decimal(18,2))) END").cast("double").alias("revenue"),
    ).select(
        F.col("l_orderkey").alias("order_id"),
        F.expr("CASE WHEN l_orderkey % 4 <> 0 THEN flags END").alias("flags"),
        "numbers",
        "suppliers",
        "revenue",
    )


ORDER_EVENTS = """
    SELECT l_orderkey AS order_id,
           CASE WHEN l_orderkey % 4 <> 0 THEN list_sort(list_distinct(list(l_returnflag))) END AS flags,
           list_sort(coalesce(list(CAST(l_linenumber AS bigint)) FILTER (WHERE l_quantity > 25), [])) AS numbers,
           list_sort(list_distinct(list(l_suppkey))) AS suppliers,
           CASE WHEN l_orderkey % 9 <> 0 THEN CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) END AS revenue
    FROM lineitem GROUP BY l_orderkey
"""


# Payloads with every kind of fault, chosen by the event's own values.
PAYLOAD = """
    CASE WHEN event_type = 'error' AND value < 20 THEN ''
         WHEN event_type = 'error' AND value < 30 THEN '{"value": '
         WHEN event_type = 'error' AND value < 40 THEN concat('[', CAST(user_id AS {text}), ', 2]')
         WHEN event_type = 'error' THEN concat('{"value": "', CAST(user_id AS {text}), '", "active": "yes", "location": 7, "tags": "a", "scores": {}}')
         WHEN event_type = 'click' THEN concat('{"value": ', CAST(user_id AS {text}), '.0, "temperature": ', CAST(user_id AS {text}), ', "active": true, "tags": ["a", 1, null, "b"], "scores": [1, "x", 2.5, ', CAST(user_id AS {text}), ']}')
         WHEN event_type = 'view' THEN concat('{"value": ', CAST(user_id AS {text}), ', "temperature": ', CAST(user_id AS {text}), '.5, "active": false, "location": "warehouse", "tags": [], "scores": ["x"], "extra": {"value": 1}}')
         WHEN event_type = 'signup' THEN concat('{"value": null, "temperature": "hot", "location": "', event_type, CAST(user_id AS {text}), '", "tags": [1, 2], "scores": [3, ', CAST(user_id AS {text}), ']}')
         ELSE concat('{"temperature": ', CAST(user_id AS {text}), '.25, "active": ', CASE WHEN value > 50 THEN 'true' ELSE 'false' END, ', "tags": ["', event_type, '"]}')
    END
"""

PAYLOAD_SCHEMA = attribute_schema(
    ["value:int", "temperature:float", "active:bool", "location:str", "tags:string_list", "scores:int_list"]
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, event_type, payload) with JSON text."""
    rows = spread(table(spark, sf_dir, "events").drop("props"))
    return rows.select("event_id", "ts", "event_type", F.expr(PAYLOAD.replace("{text}", "string")).alias("payload"))


PAYLOADS = f"SELECT event_id, ts, event_type, {PAYLOAD.replace('{text}', 'varchar')} AS payload FROM events"


# --- subscriptions ------------------------------------------------------------------------------

# One subscription per user and event type seen in the data: more than the user's usual value for
# the type, or very little of anything while the type is not that one.
ALERTS = """
    SELECT row_number() OVER (ORDER BY user_id, event_type) AS sub_id, user_id AS for_user, event_type AS for_type,
           usual
    FROM (SELECT user_id, event_type, CAST(round(CAST(sum(CAST(value AS decimal(18,2))) AS double) / count(*)) AS bigint) AS usual
          FROM events GROUP BY user_id, event_type) AS u
"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sub_id, clauses: ``(user = ? and type = ? and value > ?) or (user = ? and type <> ? and value <= 5)``."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.expr("CAST(round(CAST(sum(CAST(value AS decimal(18,2))) AS double) / count(*)) AS bigint)").alias("usual")
    )
    listed = numbered(rows, ["user_id", "event_type"], "sub_id")
    return listed.select(
        "sub_id",
        clauses_of(
            [("user_id", "=", "user_id", "int"), ("event_type", "=", "event_type", "str"), ("value", ">", "usual", "float")],
            [("user_id", "=", "user_id", "int"), ("event_type", "<>", "event_type", "str"), ("value", "<=", "5", "float")],
        ).alias("clauses"),
    )


ALERT_MATCHES = f"""
    SELECT e.event_id, a.sub_id
    FROM ({EVENTS}) e JOIN ({ALERTS}) a ON e.user_id = a.for_user
    WHERE (e.event_type = a.for_type AND e.value > a.usual) OR (e.event_type <> a.for_type AND e.value <= 5)
"""


# --- control requests ---------------------------------------------------------------------------

# Clients subscribe (signup, purchase, view) or unsubscribe (error) an expression that depends on
# the value, so that a few expressions are shared by very many clients. Clicks are operations that the library does not know.
CONTROL = """
    SELECT ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'unsub' WHEN 'click' THEN 'note' ELSE 'sub' END AS op,
           concat('client-', CAST(user_id % 20 AS {text})) AS client_id,
           CASE WHEN value >= 150 THEN concat('price > ', CAST(floor(value / 50) AS {int}))
                ELSE concat('value > ', CAST(floor(value / 16) AS {int}), ' and user_id <> ', CAST(user_id % 9 AS {text})) END AS expression,
           CASE WHEN value >= 150 THEN 'price' ELSE 'value' END AS attribute,
           CAST(floor(value / CASE WHEN value >= 150 THEN 50 ELSE 16 END) AS bigint) AS threshold,
           user_id % 9 AS other_user,
           CASE WHEN event_id % 13 <> 0 THEN concat('reply-', CAST(event_id AS {text})) END AS reply_to
    FROM events
"""
CONTROL_SQL = CONTROL.replace("{text}", "varchar").replace("{int}", "bigint")


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, seq, op, client_id, expression, clauses, reply_to."""
    text = CONTROL.replace("{text}", "string").replace("{int}", "bigint").replace("FROM events", "FROM {events}")
    rows = spark.sql(text, events=table(spark, sf_dir, "events"))
    known = clauses_of([("value", ">", "threshold", "float"), ("user_id", "<>", "other_user", "int")])
    unknown = clauses_of([("price", ">", "threshold", "float")])
    clauses = F.when(F.col("attribute") == "value", known).otherwise(unknown)
    return rows.select("ts", "seq", "op", "client_id", "expression", clauses.alias("clauses"), "reply_to")


def definitions(log: DataFrame) -> DataFrame:
    """(expression, clauses), one row per text. The same text has the same clauses."""
    return log.groupBy("expression").agg(F.any_value("clauses").alias("clauses"))

"""Matching many subscriptions against events, orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fansieve.functions.predicates import CLAUSES_TYPE, Predicate, clauses_of
from fansieve.operators.match import active_only, fan_out, match, match_ids, match_pairs, unmatched
from fansieve.operators.ordered import lookup, numbered
from fansieve.operators.subscriptions import active_subscriptions
from fansieve.plans.data import (
    ALERT_MATCHES,
    ALERTS,
    AS_OF,
    CONTROL_SQL,
    EVENT_ATTRIBUTES,
    EVENTS,
    ORDER_ATTRIBUTES,
    ORDER_EVENTS,
    PREFIX,
    TTL,
    alerts,
    definitions,
    events,
    order_events,
)
from fansieve.plans.predicates import ON_EVENTS, ON_ORDERS
from fansieve.plans.subscriptions import ACTIVE, valid_control
from fansieve.session import durable, spread, table


def subscription_table(spark, predicates: list[Predicate]) -> DataFrame:
    """Predicates written by hand, numbered from 1."""
    rows = [(i, p.sql(), p.clauses()) for i, p in enumerate(predicates, start=1)]
    return spark.createDataFrame(rows, f"sub_id bigint, expression string, clauses {CLAUSES_TYPE.simpleString()}")


def match_all(spark, sf_dir):
    subscriptions = subscription_table(spark, [p for p, _ in ON_EVENTS.values()])
    return match(events(spark, sf_dir), subscriptions, EVENT_ATTRIBUTES, strategy="template").select("event_id", "sub_id")


MATCH_ALL = " UNION ALL ".join(
    f"SELECT event_id, CAST({i} AS bigint) AS sub_id FROM ({EVENTS}) e WHERE {c}"
    for i, (_, c) in enumerate(ON_EVENTS.values(), start=1)
)


def match_compiled(spark, sf_dir):
    subscriptions = subscription_table(spark, [p for p, _ in ON_EVENTS.values()])
    matched = match(events(spark, sf_dir), subscriptions, EVENT_ATTRIBUTES, strategy="compiled")
    return matched.select("event_id", "sub_id")


def match_list_predicates(spark, sf_dir):
    subscriptions = subscription_table(spark, [p for p, _ in ON_ORDERS.values()])
    return match(order_events(spark, sf_dir), subscriptions, ORDER_ATTRIBUTES, strategy="template", key=("order_id",)).select("order_id", "sub_id")


MATCH_LIST_PREDICATES = " UNION ALL ".join(
    f"SELECT order_id, CAST({i} AS bigint) AS sub_id FROM ({ORDER_EVENTS}) e WHERE {c}"
    for i, (_, c) in enumerate(ON_ORDERS.values(), start=1)
)


def match_counts_per_sub(spark, sf_dir):
    pairs = match(events(spark, sf_dir), alerts(spark, sf_dir), EVENT_ATTRIBUTES)
    return pairs.groupBy("sub_id").agg(F.count("*").alias("matches"), F.max("event_id").alias("last_event"))


def match_ids_of_events(spark, sf_dir):
    ids = match_ids(events(spark, sf_dir), alerts(spark, sf_dir), attributes=EVENT_ATTRIBUTES)
    return ids.select("event_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("bigint").alias("n"))


def fan_out_to_topics(spark, sf_dir):
    rows = fan_out(events(spark, sf_dir), alerts(spark, sf_dir), PREFIX, attributes=EVENT_ATTRIBUTES)
    return rows.select("event_id", "sub_id", "topic", "value")


def skip_inactive_ids(spark, sf_dir):
    # A subscription stays active while its user is known as a customer with money left.
    active = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sub_id"))
    pairs = match(events(spark, sf_dir), active_only(alerts(spark, sf_dir), active), EVENT_ATTRIBUTES)
    return pairs.select("event_id", "sub_id")


def unmatched_events(spark, sf_dir):
    rows = unmatched(events(spark, sf_dir), alerts(spark, sf_dir), attributes=EVENT_ATTRIBUTES)
    return rows.select("event_id", "user_id", "event_type", "value")


def match_order_lines(spark, sf_dir):
    """Every part watches the lines that order more of it than its size."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sub_id"),
        clauses_of([("l_partkey", "=", "p_partkey", "int"), ("l_quantity", ">", "p_size", "float"), ("l_returnflag", "in", "array('A', 'N')", "strs")]).alias("clauses"),
    )
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))
    pairs = match(lines, parts, key=("l_orderkey", "l_linenumber"))
    return pairs.select("l_orderkey", "l_linenumber", "sub_id")


def _lines_and_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sub_id"),
        clauses_of(
            [("l_partkey", "=", "p_partkey", "int"), ("l_quantity", ">", "p_size", "float")],
            [("l_suppkey", "=", "p_partkey", "int"), ("l_returnflag", "=", "'R'", "str"), ("l_quantity", "<", "2", "float")],
        ).alias("clauses"),
    )
    return spread(table(spark, sf_dir, "lineitem")), parts, {"l_partkey": "integer", "l_suppkey": "integer", "l_quantity": "float", "l_returnflag": "string"}


def match_by_shuffle(spark, sf_dir):
    """Parts as a clause table that is too large to broadcast; the lines' other columns join what matched afterwards."""
    lines, parts, attributes = _lines_and_parts(spark, sf_dir)
    pairs = match(lines, parts, attributes, key=("l_orderkey", "l_linenumber"), broadcast_limit=1024)
    return pairs.select("l_orderkey", "l_linenumber", "sub_id", "l_extendedprice", "l_shipdate")


def match_pairs_by_shuffle(spark, sf_dir):
    """The same without the other columns, which are not even read."""
    lines, parts, attributes = _lines_and_parts(spark, sf_dir)
    return match_pairs(lines, parts, attributes, ("l_orderkey", "l_linenumber"), broadcast_limit=1024).select("l_orderkey", "l_linenumber", "sub_id")


def match_states(spark, sf_dir):
    """Every customer watches flagged events without a user, whatever their type but a few: nothing to hash but states."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sub_id"),
        clauses_of([("user_id", "is null"), ("flag", "true"), ("event_type", "not in", "array(c_mktsegment, 'view', 'click')", "strs")]).alias("clauses"),
    )
    pairs = match(events(spark, sf_dir), customers, EVENT_ATTRIBUTES)
    return pairs.groupBy("sub_id").agg(F.count("*").alias("matches"), F.max("event_id").alias("last_event"))


def match_texts(spark, sf_dir):
    """The alerts of ``alerts``, as texts of two kinds per user and type, with some that are no predicates."""
    usual = F.expr("CAST(round(CAST(sum(CAST(value AS decimal(18,2))) AS double) / count(*)) AS bigint)").alias("usual")
    listed = numbered(table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(usual), ["user_id", "event_type"], "sub_id")
    text = """CASE WHEN user_id % 10 = 3 THEN concat('price > ', usual) WHEN user_id % 10 = 7 THEN concat('value > and ', usual)
              ELSE concat('user_id = ', user_id, ' and (event_type = ''', event_type, ''' and value > ', usual, ' or not event_type in (''', event_type, ''') and value <= 5)') END"""
    subscriptions = listed.select("sub_id", F.expr(text).alias("expression"))
    return match(events(spark, sf_dir), subscriptions, EVENT_ATTRIBUTES).select("event_id", "sub_id")


def match_price_bands(spark, sf_dir):
    """Every customer watches a narrow band of order totals: ranges only, no equality."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sub_id"),
        clauses_of([("o_totalprice", ">", "c_acctbal * 40", "float"), ("o_totalprice", "<=", "c_acctbal * 40 + 2000", "float")]).alias("clauses"),
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    pairs = match(orders, customers, key=("o_orderkey",))
    return pairs.groupBy("sub_id").agg(F.count("*").alias("matches"), F.min("o_orderkey").alias("first_order"))


def match_suppliers(spark, sf_dir):
    """Every supplier watches the orders that hold one of its own lines or its successor's."""
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sub_id"),
        clauses_of(
            [("suppliers", "one of", "array(s_suppkey, s_suppkey + 1)", "ints"), ("numbers", "none of", "array(7)", "ints"), ("revenue", ">=", "100000", "float")],
            [("suppliers", "all of", "array(s_suppkey, s_suppkey + 2)", "ints"), ("flags", "one of", "array('R')", "strs")],
        ).alias("clauses"),
    )
    pairs = match(order_events(spark, sf_dir), suppliers, ORDER_ATTRIBUTES, key=("order_id",))
    return pairs.select("order_id", "sub_id")


def match_supplier_alarms(spark, sf_dir):
    """Every supplier watches one event type above its own threshold: ``value > ? and type = ? and user <> ?``."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    suppliers = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("sub_id"),
        clauses_of(
            [
                ("value", ">", "abs(s_acctbal) / 50", "float"),
                ("event_type", "=", "element_at(array('signup', 'purchase', 'view', 'click', 'error'), n_regionkey + 1)", "str"),
                ("user_id", "<>", "s_suppkey", "int"),
            ]
        ).alias("clauses"),
    )
    pairs = match(events(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), suppliers)
    return pairs.groupBy("event_type").agg(F.count("*").alias("matches"), F.sum("sub_id").alias("id_sum"), F.max("event_id").alias("last_event"))


def match_long_lists(spark, sf_dir):
    """Every supplier watches the users who are customers of its nation, by a list of all of them."""
    nations = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.sort_array(F.collect_list("c_custkey")).alias("users"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("sub_id"),
        clauses_of([("user_id", "in", "users", "ints"), ("value", ">", "abs(s_acctbal) / 100", "float")]).alias("clauses"),
    )
    pairs = match(events(spark, sf_dir).select("event_id", "user_id", "value"), suppliers)
    return pairs.groupBy("sub_id").agg(F.count("*").alias("matches"), F.max("event_id").alias("last_event"))


def match_as_of(spark, sf_dir):
    """Events against the subscriptions that the control log leaves active at one moment."""
    log = valid_control(spark, sf_dir)
    active = durable(active_subscriptions(log, AS_OF, TTL))
    subscriptions = lookup(active, durable(definitions(log)), ["expression"], ["sub_id"], "inner")
    pairs = match(events(spark, sf_dir), subscriptions, EVENT_ATTRIBUTES)
    return pairs.groupBy("sub_id").agg(F.count("*").alias("matches"))


def queries():
    return {
        "match_all": match_all,
        "match_compiled": match_compiled,
        "match_list_predicates": match_list_predicates,
        "match_counts_per_sub": match_counts_per_sub,
        "match_ids": match_ids_of_events,
        "fan_out": fan_out_to_topics,
        "skip_inactive_ids": skip_inactive_ids,
        "unmatched_events": unmatched_events,
        "match_order_lines": match_order_lines,
        "match_by_shuffle": match_by_shuffle,
        "match_pairs_by_shuffle": match_pairs_by_shuffle,
        "match_states": match_states,
        "match_texts": match_texts,
        "match_price_bands": match_price_bands,
        "match_suppliers": match_suppliers,
        "match_supplier_alarms": match_supplier_alarms,
        "match_long_lists": match_long_lists,
        "match_as_of": match_as_of,
    }


def oracle_sql():
    return {
        "match_all": MATCH_ALL,
        "match_compiled": MATCH_ALL,
        "match_list_predicates": MATCH_LIST_PREDICATES,
        "match_counts_per_sub": f"SELECT sub_id, count(*) AS matches, max(event_id) AS last_event FROM ({ALERT_MATCHES}) m GROUP BY sub_id",
        "match_ids": f"""
            SELECT e.event_id, coalesce(string_agg(CAST(m.sub_id AS varchar), ',' ORDER BY m.sub_id), '') AS ids,
                   count(m.sub_id) AS n
            FROM events e LEFT JOIN ({ALERT_MATCHES}) m ON m.event_id = e.event_id GROUP BY e.event_id""",
        "fan_out": f"""
            SELECT m.event_id, m.sub_id, concat('{PREFIX}.', m.sub_id) AS topic, e.value
            FROM ({ALERT_MATCHES}) m JOIN ({EVENTS}) e ON e.event_id = m.event_id""",
        "skip_inactive_ids": f"SELECT event_id, sub_id FROM ({ALERT_MATCHES}) m WHERE sub_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
        "unmatched_events": f"SELECT event_id, user_id, event_type, value FROM ({EVENTS}) e WHERE event_id NOT IN (SELECT event_id FROM ({ALERT_MATCHES}) m)",
        "match_order_lines": """
            SELECT l_orderkey, l_linenumber, p_partkey AS sub_id FROM lineitem JOIN part ON l_partkey = p_partkey
            WHERE l_quantity > p_size AND l_returnflag IN ('A', 'N')""",
        "match_by_shuffle": """
            SELECT l_orderkey, l_linenumber, p_partkey AS sub_id, l_extendedprice, l_shipdate FROM lineitem JOIN part
            ON (l_partkey = p_partkey AND l_quantity > p_size) OR (l_suppkey = p_partkey AND l_returnflag = 'R' AND l_quantity < 2)""",
        "match_pairs_by_shuffle": """
            SELECT l_orderkey, l_linenumber, p_partkey AS sub_id FROM lineitem JOIN part
            ON (l_partkey = p_partkey AND l_quantity > p_size) OR (l_suppkey = p_partkey AND l_returnflag = 'R' AND l_quantity < 2)""",
        "match_texts": f"""
            SELECT m.event_id, m.sub_id FROM ({ALERT_MATCHES}) m JOIN ({ALERTS}) a ON a.sub_id = m.sub_id WHERE a.for_user % 10 NOT IN (3, 7)""",
        "match_states": f"""
            SELECT c_custkey AS sub_id, count(*) AS matches, max(event_id) AS last_event FROM customer JOIN ({EVENTS}) e
            ON user_id IS NULL AND flag AND event_type NOT IN (c_mktsegment, 'view', 'click')
            GROUP BY c_custkey""",
        "match_price_bands": """
            SELECT c_custkey AS sub_id, count(*) AS matches, min(o_orderkey) AS first_order
            FROM orders JOIN customer ON o_totalprice > c_acctbal * 40 AND o_totalprice <= c_acctbal * 40 + 2000
            GROUP BY c_custkey""",
        "match_suppliers": f"""
            SELECT order_id, s_suppkey AS sub_id FROM ({ORDER_EVENTS}) e JOIN supplier s ON
              (list_has_any(suppliers, [s_suppkey, s_suppkey + 1]) AND NOT list_has_any(numbers, [7]) AND revenue >= 100000)
              OR (list_has_all(suppliers, [s_suppkey, s_suppkey + 2]) AND list_has_any(flags, ['R']))""",
        "match_supplier_alarms": f"""
            SELECT e.event_type, count(*) AS matches, CAST(sum(s_suppkey) AS bigint) AS id_sum, max(e.event_id) AS last_event
            FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN ({EVENTS}) e
              ON e.event_type = list_extract(['signup', 'purchase', 'view', 'click', 'error'], n_regionkey + 1)
             AND e.value > abs(s_acctbal) / 50 AND e.user_id <> s_suppkey
            GROUP BY e.event_type""",
        "match_long_lists": f"""
            SELECT s_suppkey AS sub_id, count(*) AS matches, max(e.event_id) AS last_event
            FROM supplier JOIN customer ON c_nationkey = s_nationkey JOIN ({EVENTS}) e ON e.user_id = c_custkey AND e.value > abs(s_acctbal) / 100
            GROUP BY s_suppkey""",
        "match_as_of": f"""
            WITH subscribed AS (SELECT DISTINCT expression, threshold, other_user FROM ({CONTROL_SQL}) c WHERE attribute = 'value'),
                 active AS ({ACTIVE})
            SELECT a.sub_id, count(*) AS matches FROM active a JOIN subscribed s ON s.expression = a.expression
            JOIN ({EVENTS}) e ON e.value > s.threshold AND e.user_id <> s.other_user GROUP BY a.sub_id""",
    }

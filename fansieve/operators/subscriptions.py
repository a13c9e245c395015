"""The subscription table, computed from the control log.

A subscription lives from the first subscribe request for its expression until its last holder
leaves or expires; asking for the expression again later makes a new subscription with a new id
(an *incarnation*). Ids count incarnations in order of their first request. Everything here is a
query over the log (see ``leases`` for its columns), so there is no state to restore.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.keys import lease_key
from fansieve.functions.predicates import InvalidPredicate, invalid_reason
from fansieve.operators.graph import components, uneven_join
from fansieve.operators.leases import ORDER, live_leases, point, timestamp, with_lease_end
from fansieve.operators.match import with_topic
from fansieve.operators.ordered import lay_out, lookup, numbered, pieces_for
from fansieve.session import durable

CONTROL_MESSAGE = "expression string, client_id string, id bigint"


# --- requests -----------------------------------------------------------------------------------


def control_log(messages: DataFrame) -> DataFrame:
    """Parse control messages: ``op`` and the JSON ``payload`` become fields and an ``error``.

    A subscribe message needs ``expression`` and ``client_id``, an unsubscribe message ``id`` and
    ``client_id``; each must have the right JSON type.
    """
    body = F.col("_body")

    def typed(name: str, stored: str, sql_type: str) -> Column:
        return F.expr(
            f"CASE WHEN schema_of_variant(try_variant_get(_body, '$.{name}', 'variant')) = '{stored}' "
            f"THEN try_variant_get(_body, '$.{name}', '{sql_type}') END"
        )

    rows = messages.withColumn("_body", F.try_parse_json("payload")).select(
        *(c for c in messages.columns if c != "payload"),
        typed("expression", "STRING", "string").alias("expression"),
        typed("client_id", "STRING", "string").alias("client_id"),
        typed("id", "BIGINT", "bigint").alias("id"),
        body.isNull().alias("_unreadable"),
    )
    error = (
        F.when(F.col("_unreadable"), "Bad request: not JSON")
        .when((F.col("op") == "sub") & F.col("expression").isNull(), "Bad request: expression")
        .when((F.col("op") == "unsub") & (F.col("id").isNull() | (F.col("id") < 0)), "Bad request: id")
        .when(F.col("client_id").isNull(), "Bad request: client_id")
    )
    return rows.withColumn("error", error).drop("_unreadable")


def heard(log: DataFrame) -> DataFrame:
    """Requests that count: a subscribe request without a reply address is ignored, and so is an unknown operation."""
    return log.where((F.col("op") == "unsub") | ((F.col("op") == "sub") & F.col("reply_to").isNotNull()))


def split_invalid(log: DataFrame, attributes: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests; a rejected one has a ``reason`` and never uses up an id.

    Operations other than ``sub`` and ``unsub`` are in neither.
    """
    checked = log.where(F.col("op").isin("sub", "unsub")).withColumn("reason", F.when(F.col("op") == "sub", invalid_reason(attributes)))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def validate_expression(schema_of: DataFrame, expression: str) -> None:
    """Raise ``InvalidPredicate`` unless the Spark SQL text is a predicate over the events.

    It must be a boolean over the columns, and it must hold or not hold for an event of plain values: a literal that cannot be
    read as its attribute's type passes the analysis and fails with the first event.
    """
    def plain(kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.array().cast(kind)
        if isinstance(kind, (T.StringType, T.BooleanType, T.NumericType)):
            return F.lit("" if isinstance(kind, T.StringType) else False if isinstance(kind, T.BooleanType) else 0).cast(kind)
        # Any moment will do; of other types, none.
        return F.lit("2000-01-01" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None).cast(kind)

    try:
        kind = schema_of.select(F.expr(expression).alias("holds")).schema["holds"].dataType
        if not isinstance(kind, T.BooleanType):
            raise InvalidPredicate(f"{expression!r} is a {kind.simpleString()}, not a predicate")
        row = schema_of.sparkSession.range(1).select(*(plain(f.dataType).alias(f.name) for f in schema_of.schema.fields))
        # A condition, not a column: an aggregate is a boolean too.
        row.where(F.expr(expression)).collect()
    except (AnalysisException, ParseException, NumberFormatException, ArithmeticException) as fault:
        raise InvalidPredicate(str(fault).split("\n")[0]) from fault


# --- incarnations -------------------------------------------------------------------------------


@dataclass
class History:
    """``requests``: the log with incarnation, id and removal outcome; ``subscriptions``: all incarnations."""

    requests: DataFrame
    subscriptions: DataFrame


def _with_incarnation(log: DataFrame, ttl: int) -> DataFrame:
    pieces = pieces_for(log)
    held = with_lease_end(log, ttl, pieces).rows()
    laid = lay_out(held, ["expression"], ORDER, pieces).max_before("held_to", F.col("lease_end"))
    begins = (F.col("op") == "sub") & (F.col("held_to").isNull() | (point() >= F.col("held_to")))
    rows = laid.sum_through("incarnation", begins.cast("int")).rows()
    gone = F.col("held_to").isNull() | (F.col("held_to") < point())
    outcome = F.when(
        F.col("op") == "unsub",
        F.when(gone, "not_found").when(F.col("held_to") == point(), "fully_removed").otherwise("still_active"),
    )
    return rows.withColumn("outcome", outcome).drop("held_to")


def incarnations(log: DataFrame, ttl: int) -> DataFrame:
    """Every incarnation of every expression: first request, end, number of requests and of clients."""
    return _summarise(_with_incarnation(log, ttl))


def _summarise(rows: DataFrame) -> DataFrame:
    # Clients first: the partial groups spread an expression with very many clients.
    by_client = rows.where("op = 'sub'").groupBy("expression", "incarnation", "client_id").agg(
        F.min(point()).alias("_start"), F.max("lease_end").alias("_end"), F.count("*").alias("requests")
    )
    return (
        by_client.groupBy("expression", "incarnation")
        .agg(
            F.min("_start").alias("_start"),
            F.max("_end").alias("_end"),
            F.sum("requests").alias("requests"),
            F.count("*").alias("clients"),
        )
        .select(
            "expression",
            "incarnation",
            F.col("_start.ts").alias("start_ts"),
            F.col("_start.seq").alias("start_seq"),
            F.col("_end.ts").alias("end_ts"),
            "requests",
            "clients",
        )
    )


def assign_ids(subscriptions: DataFrame, first: int = 1) -> DataFrame:
    """Number the incarnations from ``first`` in order of their first request."""
    return numbered(subscriptions, ["start_ts", "start_seq"], "sub_id", first)


def history(log: DataFrame, ttl: int) -> History:
    rows = durable(_with_incarnation(log, ttl))
    subscriptions = durable(assign_ids(_summarise(rows)))
    ids = subscriptions.select("expression", "incarnation", "sub_id")
    requests = lookup(rows, ids, ["expression", "incarnation"], ["ts", "seq"])
    # An unsubscribe request for an expression nobody holds meets no subscription.
    known = F.col("outcome").isNull() | (F.col("outcome") != "not_found")
    requests = requests.withColumn("sub_id", F.when(known, F.col("sub_id")))
    return History(requests, subscriptions)


def active_subscriptions(log: DataFrame, as_of, ttl: int, output_prefix: str | None = None) -> DataFrame:
    """(sub_id, expression[, topic]) of everything active at ``as_of``, with its stable id."""
    seen = log.where(F.col("ts") <= timestamp(as_of))
    every = assign_ids(incarnations(seen, ttl))
    active = every.where(F.col("end_ts") > timestamp(as_of)).select("sub_id", "expression")
    return with_topic(active, output_prefix) if output_prefix else active


def holders(log: DataFrame, as_of, ttl: int) -> DataFrame:
    """(sub_id, client_id) of all live holds, one row each: a subscription may have very many."""
    active = durable(active_subscriptions(log, as_of, ttl))
    live = live_leases(log, as_of, ttl).select("expression", "client_id")
    return lookup(live, active, ["expression"], ["client_id"], "inner").select("sub_id", "expression", "client_id")


def next_id(subscriptions: DataFrame) -> DataFrame:
    """The id the next new subscription gets: ids are never used twice."""
    return subscriptions.agg((F.coalesce(F.max("sub_id"), F.lit(0)) + 1).alias("next_id"))


def deduplicate(log: DataFrame) -> DataFrame:
    """One row per distinct expression text with its first request and how many clients share it."""
    by_client = log.where("op = 'sub'").groupBy("expression", "client_id").agg(
        F.min(F.struct(*ORDER)).alias("_first"), F.count("*").alias("requests")
    )
    return (
        by_client.groupBy("expression")
        .agg(F.min("_first").alias("_first"), F.sum("requests").alias("requests"), F.count("*").alias("clients"))
        .select("expression", F.col("_first.ts").alias("first_ts"), F.col("_first.seq").alias("first_seq"), "requests", "clients")
    )


def force_remove(active: DataFrame, ids: DataFrame) -> DataFrame:
    """Active subscriptions that are left after removing ``ids`` with all their holders."""
    return active.join(ids.select("sub_id").distinct(), "sub_id", "left_anti")


def force_remove_results(active: DataFrame, ids: DataFrame) -> DataFrame:
    """(sub_id, removed) for every id to remove: false if there is no such subscription."""
    known = active.select("sub_id", F.lit(True).alias("removed")).distinct()
    return ids.select("sub_id").distinct().join(known, "sub_id", "left").fillna(False, ["removed"])


# --- replies ------------------------------------------------------------------------------------


def subscribe_replies(requests: DataFrame, rejected: DataFrame, output_prefix: str, bucket: str, ttl: int) -> DataFrame:
    """The reply to every subscribe request: the subscription and its lease, or an error."""
    accepted = with_topic(requests.where("op = 'sub'"), output_prefix).select(
        "seq",
        F.col("sub_id").alias("id"),
        "topic",
        F.lit(bucket).alias("lease_bucket"),
        lease_key("sub_id", F.col("client_id")).alias("lease_key"),
        F.lit(ttl).cast("bigint").alias("lease_ttl_seconds"),
    )
    errors = rejected.select("seq", F.concat(F.lit("Invalid expression: "), F.col("reason")).alias("error"))
    return accepted.unionByName(errors, allowMissingColumns=True)


def unsubscribe_replies(requests: DataFrame) -> DataFrame:
    """The reply to every unsubscribe request; an unknown subscription counts as removed.

    A request that names an ``id`` gets it back, known or not.
    """
    asked = F.coalesce("id", "sub_id") if "id" in requests.columns else F.col("sub_id")
    return requests.where("op = 'unsub'").select("seq", asked.alias("id"), (F.col("outcome") != "still_active").alias("removed"))


def error_replies(log: DataFrame) -> DataFrame:
    """The reply to every request of ``control_log`` that could not be read."""
    return log.where("error IS NOT NULL").select("seq", "error")


# --- restore ------------------------------------------------------------------------------------


# Rounds that settle what comes first, before the rest is walked through in order; so few pairs that are left are one group, whatever hangs together.
ROUNDS, ONE_GROUP = 2, 20_000


def restore_conflicts(records: DataFrame, order=("created", "key")) -> DataFrame:
    """Which lease records can be restored together: adds ``restored``.

    Records bind their id to their expression in the given order, those without a time last; a record whose id or expression is
    already bound otherwise is refused and binds nothing. A pair alone with its id and its expression is bound at once. Of the others, a few rounds
    settle every pair that is first among the open pairs of both its id and its expression, and then the pairs these exclude. What is left hangs
    together in small groups or in chains: each connected group is walked through in order, all groups side by side.
    """
    pair = ["sub_id", "expression"]
    rank = F.struct(F.col(order[0]).isNull().alias("late"), *order)
    pairs = durable(records.groupBy(*pair).agg(F.min(rank).alias("rank")))
    by_id = durable(pairs.groupBy("sub_id").agg(F.count("*").alias("_id_pairs")))
    by_text = durable(pairs.groupBy("expression").agg(F.count("*").alias("_text_pairs")))
    counted = lookup(pairs, by_id, ["sub_id"], ["expression"], "inner")
    counted = durable(lookup(counted, by_text, ["expression"], ["sub_id"], "inner"))
    alone = F.expr("_id_pairs = 1 AND _text_pairs = 1")
    settled = [counted.where(alone).select(*pair)]
    open_pairs = durable(counted.where(~alone).select(*pair, "rank"))
    for _ in range(ROUNDS):
        if not open_pairs.head(1):
            break
        by_id = durable(open_pairs.groupBy("sub_id").agg(F.min("rank").alias("_id_rank")))
        by_text = durable(open_pairs.groupBy("expression").agg(F.min("rank").alias("_text_rank")))
        ranked = lookup(open_pairs, by_id, ["sub_id"], ["expression"], "inner")
        ranked = lookup(ranked, by_text, ["expression"], ["sub_id"], "inner")
        ranked = durable(ranked.withColumn("_wins", F.expr("rank = _id_rank AND rank = _text_rank")))
        won = ranked.where("_wins").select(*pair)
        settled.append(won)
        left = ranked.where("NOT _wins").select(*pair, "rank")
        left = _without(left, won, "sub_id", "expression")
        open_pairs = durable(_without(left, won, "expression", "sub_id"))
    if open_pairs.head(1):
        settled.append(_walk(open_pairs))
    bound = durable(reduce(DataFrame.unionByName, settled).withColumn("restored", F.lit(True)))
    return lookup(records, bound, pair, list(order)).fillna(False, ["restored"])


def _walk(pairs: DataFrame) -> DataFrame:
    """The pairs that bind, one after the other by ``rank`` in each group of pairs that share ids or expressions."""
    kinds = f"sub_id {pairs.schema['sub_id'].dataType.simpleString()}, expression string"
    # An id and an expression are nodes, a pair is an edge. Two nodes with the same hash only make a group larger.
    of_id, of_text = F.xxhash64(F.lit("id"), "sub_id"), F.xxhash64(F.lit("text"), "expression")
    if pairs.count() <= ONE_GROUP:
        grouped = pairs.withColumn("label", F.lit(0))
    else:
        labels = components(pairs.select(of_id.alias("a"), of_text.alias("b")))
        grouped = uneven_join(durable(pairs.withColumn("_node", of_id)), labels, "_node", "node").drop("_node", "node")

    def walk(batches):
        group, ids, texts = None, set(), set()
        for batch in batches:
            won = []
            for now, i, text in zip(*(batch.column(c).to_pylist() for c in ("label", "sub_id", "expression")), strict=True):
                if now != group:
                    group, ids, texts = now, set(), set()
                if i not in ids and text not in texts:
                    ids.add(i)
                    texts.add(text)
                    won.append((i, text))
            schema = pa.schema([("sub_id", batch.schema.field("sub_id").type), ("expression", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in won], f.type) for k, f in enumerate(schema)], schema=schema)

    return grouped.repartition("label").sortWithinPartitions("label", "rank").select("label", "sub_id", "expression").mapInArrow(walk, kinds)


def _without(pairs: DataFrame, won: DataFrame, column: str, spread_by: str) -> DataFrame:
    taken = won.select(column, F.lit(True).alias("_taken"))
    return lookup(pairs, taken, [column], [spread_by]).where("_taken IS NULL").drop("_taken")

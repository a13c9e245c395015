"""Statistics, schema tools and streaming runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fansieve.functions.attributes import attributes_of
from fansieve.functions.predicates import clauses_of
from fansieve.operators import stats
from fansieve.operators.decode import parse_payload, typed_events
from fansieve.operators.infer import catalog_schema, infer_schema, rejected_samples, schema_text
from fansieve.operators.match import match_ids
from fansieve.operators.ordered import lay_out
from fansieve.plans.data import EVENT_ATTRIBUTES, EVENT_COLUMNS, PAYLOAD_SCHEMA, PAYLOADS, PREFIX, payloads
from fansieve.plans.matching import MATCH_ALL, subscription_table
from fansieve.plans.payloads import MAX_BYTES, TYPED
from fansieve.plans.predicates import ON_EVENTS
from fansieve.session import shared_folder, table
from fansieve.sources.inputs import read_inputs
from fansieve.sources.topics import TopicTable
from fansieve.streaming.router import route_stream, window_counts

#: Counters that are known before matching.
TAKEN_IN = ("received", "empty", "input_dropped", "processed", "match_failures")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def payload_watchers(spark, sf_dir):
    """Every customer watches readings above its nation's number for its own number."""
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        F.col("c_custkey").alias("sub_id"),
        clauses_of(
            [("value", "=", "c_custkey", "int"), ("temperature", ">", "c_nationkey", "float")],
            [("scores", "one of", "array(c_custkey)", "ints"), ("tags", "is empty")],
        ).alias("clauses"),
    )


def _flow(spark, sf_dir):
    """Counters per message: what was taken in, and what it matched. Each message is parsed once and stays in its row."""
    messages = payloads(spark, sf_dir).select("event_id", "ts", "payload")
    decoded = parse_payload(messages, into="_body").withColumn("decodable", F.col("_body").isNotNull())
    taken_in = stats.intake(decoded, F.col("decodable"), max_bytes=MAX_BYTES)
    usable = F.expr("CASE WHEN processed = 1 THEN _body END")
    typed = typed_events(taken_in.withColumn("_body", usable), PAYLOAD_SCHEMA, "_body", keep=["event_id", "ts", *TAKEN_IN])
    typed = typed.withColumn("decodable", F.expr("processed = 1 AND match_failures = 0"))
    ids = match_ids(typed, payload_watchers(spark, sf_dir), decodable="decodable", attributes=attributes_of(PAYLOAD_SCHEMA), carry=["ts", *TAKEN_IN])
    return stats.counted(ids)


def match_stats(spark, sf_dir):
    counted = stats.totals(_flow(spark, sf_dir))
    subscriptions = payload_watchers(spark, sf_dir).agg(F.count("*").alias("subscriptions"))
    wide = counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, stats.COUNTERS)), F.array(*stats.COUNTERS))).alias("counter", "value"))
    return wide.unionByName(subscriptions.select(F.lit("subscriptions").alias("counter"), F.col("subscriptions").alias("value")))


def stats_by_window(spark, sf_dir):
    """Counters per hour, and published rows so far."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    hourly = stats.totals(_flow(spark, sf_dir), by=(hour,))
    return lay_out(hourly, [], ["hour"]).sum_through("published_so_far", F.col("published")).rows()


def infer_schema_query(spark, sf_dir):
    """From all payloads; those that are no map are left out here and counted by ``schema_sample_rejects``."""
    return infer_schema(payloads(spark, sf_dir).select("event_id", "payload"), ["event_id"], strict=False)


def schema_sample_rejects(spark, sf_dir):
    return rejected_samples(payloads(spark, sf_dir).select("event_id", "payload"))


def schema_text_query(spark, sf_dir):
    return schema_text(infer_schema_query(spark, sf_dir))


def catalog_schema_query(spark, sf_dir):
    """Attribute types of every table and how many of its rows define each attribute."""
    out = None
    for name in TABLES:
        df = table(spark, sf_dir, name)
        columns = catalog_schema(df)
        counts = df.agg(*(F.count(F.col(c)).alias(c) for _, c, _ in columns))
        entries = F.explode(
            F.array(
                *(
                    F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(c).alias("attribute"), F.lit(k).alias("type"), F.col(c).alias("defined"))
                    for i, c, k in columns
                )
            )
        )
        rows = counts.select(F.lit(name).alias("table_name"), entries.alias("e")).select("table_name", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _event_stream(spark, sf_dir, max_files=None):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    # A file stream reads folders or patterns, not single files.
    return read_inputs(spark, {"events": f"{sf_dir}/event[s].parquet"}, schema=schema, streaming=True, max_files=max_files)


def stream_route(spark, sf_dir):
    """Events matched as a stream; what arrived per topic is the same as in a batch."""
    base = f"{shared_folder(spark)}/fansieve/stream-{uuid.uuid4().hex}"
    stream = _event_stream(spark, sf_dir).selectExpr(*EVENT_COLUMNS)

    def snapshot(session, batch):
        return subscription_table(session, [p for p, _ in ON_EVENTS.values()])

    run = route_stream(stream, snapshot, PREFIX, f"{base}/out", f"{base}/checkpoint", attributes=EVENT_ATTRIBUTES)
    run.awaitTermination()
    arrived = TopicTable(spark, f"{base}/out").read()
    return arrived.groupBy("topic").agg(F.count("*").alias("records"), F.max("event_id").alias("last_event"))


def stream_counts(spark, sf_dir):
    """Event-time windows over the stream; a window's latest update holds its counts."""
    base = f"{shared_folder(spark)}/fansieve/counts-{uuid.uuid4().hex}"
    counted = window_counts(
        _event_stream(spark, sf_dir),
        [F.count("*").alias("received"), F.count_if(F.col("event_type") == "error").alias("errors")],
        every="1 hour",
    )
    writer = counted.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
    writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("window_start timestamp, received bigint, errors bigint, batch int").parquet(f"{base}/out")
    last = rows.groupBy("window_start").agg(F.max_by(F.struct("received", "errors"), "batch").alias("last"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "last.received", "last.errors")


def queries():
    return {
        "match_stats": match_stats,
        "stats_by_window": stats_by_window,
        "infer_schema": infer_schema_query,
        "schema_sample_rejects": schema_sample_rejects,
        "schema_text": schema_text_query,
        "catalog_schema": catalog_schema_query,
        "stream_route": stream_route,
        "stream_counts": stream_counts,
    }


# --- the same in SQL ----------------------------------------------------------------------------

_PAIRS = f"""
    SELECT e.event_id, c_custkey AS sub_id
    FROM (SELECT * FROM ({TYPED}) t WHERE decodable AND event_id IN (SELECT event_id FROM ({PAYLOADS}) p WHERE octet_length(encode(payload)) <= {MAX_BYTES})) e
    JOIN customer ON (e.value = c_custkey AND e.temperature > c_nationkey)
                  OR (list_contains(e.scores, CAST(c_custkey AS varchar)) AND len(e.tags) = 0)
"""
_COUNTED = f"""
    SELECT p.event_id, p.ts, 1 AS received, CAST(payload = '' AS int) AS empty, CAST(big AS int) AS input_dropped,
           CAST(payload <> '' AND NOT big AS int) AS processed,
           CAST(payload <> '' AND NOT big AND coalesce(json_type(TRY_CAST(payload AS json)), '') <> 'OBJECT' AS int) AS match_failures,
           CAST(coalesce(n, 0) > 0 AS int) AS matched, coalesce(n, 0) AS published
    FROM (SELECT *, octet_length(encode(payload)) > {MAX_BYTES} AS big FROM ({PAYLOADS}) q) p
    LEFT JOIN (SELECT event_id, count(*) AS n FROM ({_PAIRS}) m GROUP BY event_id) m ON m.event_id = p.event_id
"""
_SAMPLES = f"SELECT event_id, j FROM (SELECT event_id, TRY_CAST(payload AS json) AS j FROM ({PAYLOADS}) p) t WHERE coalesce(json_type(j), '') = 'OBJECT'"
_KEYS = f"""
    SELECT event_id, key AS attribute, json_extract(j, concat('$.', key)) AS v FROM (SELECT event_id, j, unnest(json_keys(j)) AS key FROM ({_SAMPLES}) s) k
"""
_KINDS = f"""
    SELECT event_id, attribute, CASE json_type(v) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer'
             WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string'
             WHEN 'ARRAY' THEN CASE WHEN json_type(v, '$[0]') IN ('BIGINT', 'UBIGINT') THEN 'integer_list' ELSE 'string_list' END END AS type
    FROM ({_KEYS}) k
"""
_INFERRED = f"""
    SELECT attribute, coalesce(arg_min(type, event_id) FILTER (WHERE type IS NOT NULL), 'string') AS type,
           count(type) = 0 AS warning, count(DISTINCT type) > 1 AS conflict
    FROM ({_KINDS}) k GROUP BY attribute
"""
# The columns of the given tables with their attribute types.
_COLUMNS = """
region: r_regionkey integer, r_name string
nation: n_nationkey integer, n_name string, n_regionkey integer
customer: c_custkey integer, c_name string, c_nationkey integer, c_acctbal float, c_mktsegment string
supplier: s_suppkey integer, s_name string, s_nationkey integer, s_acctbal float
part: p_partkey integer, p_name string, p_brand string, p_type string, p_size integer, p_retailprice float
orders: o_orderkey integer, o_custkey integer, o_orderstatus string, o_totalprice float, o_orderdate string, o_orderpriority string
lineitem: l_orderkey integer, l_partkey integer, l_suppkey integer, l_linenumber integer, l_quantity float, l_extendedprice float, l_discount float, l_tax float, l_returnflag string, l_linestatus string, l_shipdate string
events: event_id integer, ts string, user_id integer, event_type string, value float, props string
documents: doc_id integer, text string, lang string, source string, n_chars integer
embeddings: vec_id integer, embedding string_list, label integer
pages: page_id integer, url string, html string
benchmark: item_id integer, text string
labels: doc_id integer, quality integer, toxic integer
conversations: conv_id integer, turn integer, role string, text string
"""


def _catalog_sql() -> str:
    parts = []
    for line in _COLUMNS.strip().splitlines():
        name, columns = line.split(": ")
        for i, column in enumerate(columns.split(", "), start=1):
            attribute, kind = column.split()
            parts.append(
                f"SELECT '{name}' AS table_name, CAST({i} AS bigint) AS ordinal, '{attribute}' AS attribute, '{kind}' AS type, count({attribute}) AS defined FROM {name}"
            )
    return " UNION ALL ".join(parts)


def oracle_sql():
    sums = ", ".join(f"CAST(sum({c}) AS bigint) AS {c}" for c in stats.COUNTERS)
    return {
        "match_stats": f"""
            WITH t AS (SELECT {sums} FROM ({_COUNTED}) c)
            SELECT counter, value FROM t UNPIVOT (value FOR counter IN ({', '.join(stats.COUNTERS)}))
            UNION ALL SELECT 'subscriptions', count(*) FROM customer""",
        "stats_by_window": f"""
            SELECT *, CAST(sum(published) OVER (ORDER BY hour) AS bigint) AS published_so_far
            FROM (SELECT date_trunc('hour', ts) AS hour, {sums} FROM ({_COUNTED}) c GROUP BY 1) h""",
        "infer_schema": _INFERRED,
        "schema_sample_rejects": f"""
            SELECT CASE WHEN j IS NULL THEN 'unreadable' ELSE 'not a map' END AS reason, count(*) AS samples
            FROM (SELECT TRY_CAST(payload AS json) AS j FROM ({PAYLOADS}) p) t WHERE coalesce(json_type(j), '') <> 'OBJECT' GROUP BY 1""",
        "schema_text": f"""
            SELECT concat('attributes:', chr(10), string_agg(concat('  - name: ', attribute, chr(10), '    type: ', type, chr(10)), '' ORDER BY attribute)) AS text
            FROM ({_INFERRED}) i""",
        "catalog_schema": _catalog_sql(),
        "stream_route": f"""
            SELECT concat('{PREFIX}.', m.sub_id) AS topic, count(*) AS records, max(m.event_id) AS last_event FROM ({MATCH_ALL}) m GROUP BY m.sub_id""",
        "stream_counts": """
            SELECT date_trunc('hour', ts) AS window_start, count(*) AS received, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""",
    }

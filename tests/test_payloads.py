"""Decoding, keys, inference, inputs, outputs and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fansieve.functions.attributes import attribute_schema
from fansieve.functions.keys import key_matches, lease_key, parse_lease_key
from fansieve.functions.predicates import CLAUSES_TYPE, attr
from fansieve.operators.decode import decode_payloads, within_size
from fansieve.operators.infer import SampleError, catalog_schema, infer_schema, schema_text
from fansieve.operators.match import fan_out, match_ids, with_topic
from fansieve.operators.stats import counted, intake, totals
from fansieve.sources.inputs import default_output_prefix, read_inputs, union_subjects
from fansieve.sources.sinks import route, topic_records
from fansieve.streaming.router import append_control_log, latest_event_time, log_snapshot, route_stream, stored_snapshot, window_counts
from fansieve.sources.topics import TopicTable

SCHEMA = attribute_schema(["b:bool", "i:int", "f:float", "s:str", "sl:string_list", "il:int_list", "odd-name.x:int"])


def decode(spark, *payloads):
    df = spark.createDataFrame([(n, p) for n, p in enumerate(payloads)], "n bigint, payload string")
    return [r.asDict() for r in decode_payloads(df, SCHEMA).orderBy("n").collect()]


def test_typed_extraction(spark):
    right, wrong, lists, absent, broken, array, nested = decode(
        spark,
        '{"b": true, "i": 42, "f": 1.5, "s": "x", "sl": ["a"], "il": [1], "odd-name.x": 7, "other": 1}',
        '{"b": 1, "i": 42.0, "f": "1.5", "s": 5, "sl": "a", "il": {"a": 1}}',
        '{"f": 3, "sl": ["a", 1, null, "b"], "il": [1, 2.5, "x", null, -3], "i": 9223372036854775808}',
        '{"b": null}',
        "\x93 no json",
        "[1, 2]",
        '{"sl": [1, 2], "il": [], "i": -9223372036854775808, "s": ""}',
    )
    assert right | {"payload": None} == {"n": 0, "payload": None, "decodable": True, "b": True, "i": 42, "f": 1.5, "s": "x", "sl": ["a"], "il": [1], "odd-name.x": 7}
    assert [wrong[k] for k in SCHEMA.names] == [None] * 7 and wrong["decodable"]
    assert (lists["f"], lists["sl"], lists["il"], lists["i"]) == (3.0, ["a", "b"], [1, -3], None)
    assert [absent[k] for k in SCHEMA.names] == [None] * 7 and absent["decodable"]
    assert not broken["decodable"] and not array["decodable"]
    # All elements of the wrong type leave an empty list, which is not undefined.
    assert (nested["sl"], nested["il"], nested["i"], nested["s"]) == ([], [], -(2**63), "")


def test_binary_payloads_and_limits(spark):
    df = spark.createDataFrame([(1, b'{"i": 1}'), (2, b""), (3, "{\"s\": \"é\"}".encode())], "n bigint, payload binary")
    assert [r["n"] for r in decode_payloads(df, SCHEMA).orderBy("n").collect()] == [1, 3]
    assert within_size(df, 10).count() == 2  # the last one has eleven bytes
    with pytest.raises(ValueError):
        within_size(df, 0)


def test_counters(spark):
    messages = spark.createDataFrame(
        [(1, '{"i": 5}'), (2, ""), (3, "[1]"), (4, "{"), (5, '{"i": 1}'), (6, '{"s": "' + "x" * 50 + '"}')], "event_id bigint, payload string"
    )
    decoded = decode_payloads(messages, SCHEMA, max_bytes=40)
    subscriptions = spark.createDataFrame(
        [(i, p.clauses()) for i, p in enumerate([attr("i") > 2, attr("i") > 4])], f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}"
    )
    ids = match_ids(decoded, subscriptions, decodable="decodable")
    assert {r["event_id"]: r["ids"] for r in ids.collect()} == {1: [0, 1], 3: None, 4: None, 5: []}
    pairs = ids.select("event_id", F.explode("ids").alias("sub_id"))
    assert {tuple(r) for r in pairs.collect()} == {(1, 0), (1, 1)}
    taken = intake(messages, F.expr("startswith(schema_of_variant(try_parse_json(payload)), 'OBJECT')"), max_bytes=40)
    rows = counted(taken.join(ids, "event_id", "left"))
    assert totals(rows).first().asDict() == {
        "received": 6, "empty": 1, "input_dropped": 1, "processed": 4, "match_failures": 2, "matched": 1, "published": 2
    }


def test_lease_keys(spark):
    keys = ["5.pump", "42.a.b", "007.x", "18446744073709551615.x", "18446744073709551616.x", "9" * 60 + ".x",
            "5", ".", "5.", ".pump", "5 .pump", "x5.pump", "5x.pump", "0x5.pump", "5,pump", " 42.x", "-1.x"]
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", parse_lease_key("key").alias("p"))
    got = {r["key"]: r["p"] and (int(r["p"]["sub_id"]), r["p"]["client_id"]) for r in df.collect()}
    assert got == {
        "5.pump": (5, "pump"),
        "42.a.b": (42, "a.b"),
        "007.x": (7, "x"),
        "18446744073709551615.x": (2**64 - 1, "x"),
    } | dict.fromkeys(keys[4:])
    assert spark.range(1).select(lease_key(F.lit(42), F.lit("a.b")).alias("k")).first()["k"] == "42.a.b"


def test_key_patterns(spark):
    cases = [("a.b.c", "a.*.c", True), ("a.b.c", "a.*", False), ("a.b.c", "a.>", True), ("a", "a.>", True), ("b", "a.>", False),
             ("a.b", ">", True), ("a.b", "*.*", True), ("a.b", "*", False), ("a+b", "a+b", True), ("aab", "a+b", False),
             ("a.b\n", "a.b", False), ("a..c", "a.*.c", True), ("ab.c", "a.>", False)]
    for key, pattern, expected in cases:
        df = spark.createDataFrame([(key,)], "key string")
        assert df.select(key_matches("key", pattern)).first()[0] is expected, (key, pattern)


def samples(spark, *payloads):
    return spark.createDataFrame([(n, p) for n, p in enumerate(payloads)], "n bigint, payload string")


def test_inference(spark):
    one = samples(spark, '{"active": true, "age": 30, "price": 9.5, "name": "x", "scores": [1], "tags": ["a"], "empty": [], "mystery": null, "map": {}}')
    got = {r["attribute"]: (r["type"], r["warning"]) for r in infer_schema(one, ["n"]).collect()}
    assert got == {
        "active": ("boolean", False), "age": ("integer", False), "price": ("float", False), "name": ("string", False),
        "scores": ("integer_list", False), "tags": ("string_list", False), "empty": ("string_list", False),
        "mystery": ("string", True), "map": ("string", True),
    }
    several = infer_schema(samples(spark, '{"a": null}', '{"a": 1, "b": "x"}', '{"a": "x"}'), ["n"])
    assert {r["attribute"]: (r["type"], r["conflict"]) for r in several.collect()} == {"a": ("integer", True), "b": ("string", False)}
    assert schema_text(several).first()["text"] == "attributes:\n  - name: a\n    type: integer\n  - name: b\n    type: string\n"
    for bad in ("[1, 2, 3]", "nonsense"):
        with pytest.raises(SampleError):
            infer_schema(samples(spark, bad), ["n"])


def test_catalog(spark):
    df = spark.sql(
        "SELECT true a, 1S b, 1 c, 1L d, 1.5F e, 1.5D f, 1.5 g, 'x' h, array(1S) i, array(1) j, array(1L) k, array('x') l, array(1.5D) m, "
        "current_date() n, current_timestamp() o"
    )
    kinds = ["boolean", *["integer"] * 3, *["float"] * 3, "string", *["integer_list"] * 3, *["string_list"] * 2, "string", "string"]
    assert catalog_schema(df) == [(i, c, k) for i, (c, k) in enumerate(zip(df.columns, kinds), start=1)]


def test_prefix_rule():
    assert default_output_prefix({"in": "path"}) == "in"
    assert default_output_prefix({"a": "x", "b": "y"}, "out") == "out"
    for subjects in ({}, {"a": "x", "b": "y"}):
        with pytest.raises(ValueError):
            default_output_prefix(subjects)


def test_inputs_and_outputs(spark, tmp_path):
    for name in "ab":
        spark.createDataFrame([(1, f"from {name}")], "event_id bigint, payload string").write.parquet(str(tmp_path / name))
    both = read_inputs(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert {(r["subject"], r["payload"]) for r in both.collect()} == {("a", "from a"), ("b", "from b")}
    with pytest.raises(Exception):
        read_inputs(spark, {"a": str(tmp_path / "a"), "c": str(tmp_path / "missing")})
    with pytest.raises(ValueError):
        read_inputs(spark, {})
    with pytest.raises(ValueError):
        read_inputs(spark, {"a": "x"}, streaming=True, schema="a int", max_bytes=0)
    with pytest.raises(ValueError):
        union_subjects({})
    routed = both.withColumn("topic", F.concat_ws(".", F.lit("out"), F.col("subject")))
    assert topic_records(routed).columns == ["topic", "value"]
    route(topic_records(routed), str(tmp_path / "out"), format="text")
    assert (tmp_path / "out" / "topic=out.a").exists()
    assert {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"from a", "from b"}


def test_streams_match_like_batches(spark, tmp_path):
    """Several micro-batches, each against the subscriptions active at its time, from a streamed log."""
    schema = "event_id bigint, ts timestamp_ntz, value bigint"
    for n in range(3):
        rows = [(10 * n + i, datetime(2024, 1, 1, n, i), i) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events" / f"part{n}"))
    log_schema = "ts timestamp_ntz, seq bigint, op string, client_id string, expression string"
    requests = [
        (datetime(2024, 1, 1, 0, 0), 1, "sub", "a", "value > 5"),
        (datetime(2024, 1, 1, 1, 5), 2, "sub", "a", "value < 2"),
        (datetime(2024, 1, 1, 1, 6), 3, "unsub", "a", "value > 5"),
    ]
    spark.createDataFrame(requests, log_schema).coalesce(1).write.parquet(str(tmp_path / "requests"))
    incoming = spark.readStream.schema(log_schema).parquet(str(tmp_path / "requests"))
    append_control_log(incoming, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()

    texts = {"value > 5": attr("value") > 5, "value < 2": attr("value") < 2}
    definitions = spark.createDataFrame([(t, p.clauses()) for t, p in texts.items()], f"expression string, clauses {CLAUSES_TYPE.simpleString()}")
    stream = read_inputs(spark, {"in": str(tmp_path / "events" / "*")}, schema=schema, streaming=True, max_files=1)
    snapshot = log_snapshot(str(tmp_path / "log"), definitions, 24 * 3600, latest_event_time())
    query = route_stream(stream, snapshot, "out", str(tmp_path / "out"), str(tmp_path / "c2"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    topics = TopicTable(spark, str(tmp_path / "out"))
    got = {(r["event_id"], r["topic"]) for r in topics.read().collect()}
    # The first part sees subscription 1, the later ones only subscription 2.
    assert got == {(i, "out.1") for i in range(6, 10)} | {(10 * n + i, "out.2") for n in (1, 2) for i in (0, 1)}
    assert {(r["event_id"], r["batch"]) for r in topics.read("out.2").collect()} == {(10, 1), (11, 1), (20, 2), (21, 2)}
    assert {r["counter"]: r["value"] for r in topics.totals().collect()} == {"received": 30, "matched": 8, "published": 8}

    # The same with stored snapshots: each batch reads the requests since the one before.
    read = []
    stored = stored_snapshot(str(tmp_path / "log"), str(tmp_path / "store"), definitions.union(definitions), 24 * 3600, lambda b: read.append(latest_event_time()(b)) or read[-1])
    again = route_stream(stream, stored, "out", str(tmp_path / "out2"), str(tmp_path / "c3"))
    again.awaitTermination()
    assert {(r["event_id"], r["topic"]) for r in TopicTable(spark, str(tmp_path / "out2")).read().collect()} == got
    assert [r["as_of"] for r in spark.read.parquet(str(tmp_path / "store" / "versions")).orderBy("as_of").collect()] == read


@pytest.mark.parametrize("when", ["before the commit", "after the commit"])
def test_a_batch_that_is_retried_arrives_once(spark, tmp_path, monkeypatch, when):
    schema = "event_id bigint, value bigint"
    for n in range(3):
        spark.createDataFrame([(10 * n + i, i) for i in range(10)], schema).coalesce(1).write.parquet(str(tmp_path / "events" / f"part{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events" / "*"))
    predicates = [attr("value") > 6, attr("value") > 8, attr("value") == 0]
    subscriptions = spark.createDataFrame([(i, p.clauses()) for i, p in enumerate(predicates)], f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}")

    def run():
        query = route_stream(stream, lambda s, b: subscriptions, "out", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()

    commit = TopicTable._commit

    def fails(self, batch_id, manifest):
        if when == "after the commit":
            commit(self, batch_id, manifest)
        if batch_id == 1:
            raise RuntimeError("killed")
        if when == "before the commit":
            commit(self, batch_id, manifest)

    monkeypatch.setattr(TopicTable, "_commit", fails)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(TopicTable, "_commit", commit)
    run()
    topics = TopicTable(spark, str(tmp_path / "out"))
    rows = [(r["event_id"], r["topic"]) for r in topics.read().collect()]
    want = {(10 * n + i, f"out.{s}") for n in range(3) for s, of in enumerate(([7, 8, 9], [9], [0])) for i in of}
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r["counter"]: r["value"] for r in topics.totals().collect()} == {"received": 30, "matched": 12, "published": 15}
    assert topics.manifests().count() == 3


def test_files_do_not_grow_with_topics(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS event_id", "concat('t', id % 1000) AS topic", "repeat('x', 20) AS payload")
    topics = TopicTable(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        topics.read()
    assert topics.write(rows, 7) and not topics.write(rows, 7)
    found = topics.read("t5", "t6")
    assert found.count() == 8 and {r["batch"] for r in found.collect()} == {7}
    assert len(list((tmp_path / "data").glob("*/*.parquet"))) <= 8
    assert topics.read().drop("batch").exceptAll(rows).isEmpty() and topics.read().count() == 4000


def test_stream_counts_like_a_table(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 0, 0, i % 50)) for i in range(200)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    counters = [F.count("*").alias("received")]
    stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz").parquet(str(tmp_path / "in"))
    query = window_counts(stream, counters).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    table = window_counts(spark.read.parquet(str(tmp_path / "in")), counters)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, table.collect()))


def test_topics(spark):
    df = with_topic(spark.range(2).withColumnRenamed("id", "sub_id"), "a.b")
    assert [r["topic"] for r in df.orderBy("sub_id").collect()] == ["a.b.0", "a.b.1"]


def test_payload_is_routed_unchanged(spark):
    text = json.dumps({"i": 3, "note": "ä ü"}, ensure_ascii=False)
    messages = spark.createDataFrame([(1, text)], "event_id bigint, payload string")
    decoded = decode_payloads(messages, SCHEMA)
    subscriptions = spark.createDataFrame([(4, (attr("i") == 3).clauses())], f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}")
    assert [tuple(r) for r in topic_records(fan_out(decoded, subscriptions, "out")).collect()] == [("out.4", text)]

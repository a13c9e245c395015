"""Leases and subscriptions against a step-by-step simulation of the control plane."""

import random
from datetime import datetime, timedelta

import pytest

from fansieve.operators import graph, ordered, subscriptions
from fansieve.operators.leases import check_records, current_leases, latest_records, lease_intervals, lease_status, live_leases, reconcile

TTL = 100
START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, seq bigint, op string, client_id string, expression string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def random_log(r, n):
    rows, now = [], 0
    for seq in range(n):
        now += r.choice([0, 0, 1, 5, 20, TTL])  # equal times and gaps of exactly one TTL
        # One expression and one client hold a third of the requests.
        expression = "hot" if r.random() < 0.33 else f"e{r.randrange(6)}"
        client = "c0" if r.random() < 0.33 else f"c{r.randrange(5)}"
        rows.append((at(now), seq, "unsub" if r.random() < 0.3 else "sub", client, expression))
    return rows


def simulate(rows):
    """What a server does that handles one request after the other."""
    holders, ids, born, next_id = {}, {}, {}, 1
    answers, lived = {}, []

    def leave(expression, client, when):
        holders[expression].pop(client)
        if not holders[expression]:
            lived.append((ids[expression], expression, born.pop(expression), when))
            del holders[expression], ids[expression]

    for ts, seq, op, client, expression in rows:
        due = sorted((end, e, c) for e, hs in holders.items() for c, end in hs.items() if end <= ts)
        for end, e, c in due:
            leave(e, c, end)
        if op == "sub":
            if expression not in holders:
                holders[expression], ids[expression], born[expression] = {}, next_id, ts
                next_id += 1
            holders[expression][client] = ts + timedelta(seconds=TTL)
            answers[seq] = (ids[expression], None)
        elif expression not in holders:
            answers[seq] = (None, "not_found")
        else:
            sub_id = ids[expression]
            if client in holders[expression]:
                leave(expression, client, ts)
            answers[seq] = (sub_id, "still_active" if expression in holders else "fully_removed")
    active = {(ids[e], e, c) for e, hs in holders.items() for c in hs}
    for e in list(holders):
        for c, end in sorted(holders[e].items(), key=lambda x: x[1]):
            leave(e, c, end)
    return answers, sorted(lived), active


@pytest.fixture(params=[1_000_000, 40], ids=["one piece", "many pieces"])
def pieces(request, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", request.param)


@pytest.mark.parametrize("seed", [1, 2])
def test_history(spark, pieces, seed):
    rows = random_log(random.Random(seed), 300)
    answers, lived, _ = simulate(rows)
    done = subscriptions.history(spark.createDataFrame(rows, SCHEMA), TTL)
    got = {r["seq"]: (r["sub_id"], r["outcome"]) for r in done.requests.collect()}
    assert got == answers
    found = sorted((r["sub_id"], r["expression"], r["start_ts"], r["end_ts"]) for r in done.subscriptions.collect())
    assert found == lived
    assert subscriptions.next_id(done.subscriptions).first()["next_id"] == len(lived) + 1
    replies = {r["seq"]: r["removed"] for r in subscriptions.unsubscribe_replies(done.requests).collect()}
    assert replies == {s: o != "still_active" for s, (_, o) in answers.items() if o}


@pytest.mark.parametrize("cut", [60, 150, 299])
def test_active_as_of(spark, cut):
    rows = random_log(random.Random(3), 300)
    as_of = rows[cut][0]
    log = spark.createDataFrame(rows, SCHEMA)
    seen = [r for r in rows if r[0] <= as_of]
    _, _, active = simulate(seen + [(as_of, 10**6, "unsub", "nobody", "nothing")])
    got = {(r["sub_id"], r["expression"], r["client_id"]) for r in subscriptions.holders(log, as_of, TTL).collect()}
    assert got == active
    snapshot = subscriptions.active_subscriptions(log, as_of, TTL, "out").collect()
    assert {(r["sub_id"], r["expression"], r["topic"]) for r in snapshot} == {(i, e, f"out.{i}") for i, e, _ in active}


def test_lease_intervals(spark, pieces):
    rows = random_log(random.Random(4), 300)
    expected = []
    for lease in {(r[4], r[3]) for r in rows}:
        start = end = None
        for ts, _, op, client, expression in [*rows, (at(10**6), 0, "unsub", lease[1], lease[0])]:
            if (expression, client) != lease:
                continue
            if start is not None and end <= ts:
                expected.append((*lease, start, end, "expired"))
                start = None
            if op == "sub":
                start, end = start or ts, ts + timedelta(seconds=TTL)
            elif start is not None:
                expected.append((*lease, start, ts, "deleted"))
                start = None
    got = lease_intervals(spark.createDataFrame(rows, SCHEMA), TTL)
    assert sorted(tuple(r) for r in got.select("expression", "client_id", "start_ts", "end_ts", "ended_by").collect()) == sorted(expected)


def test_lease_states(spark):
    rows = [
        (at(0), 1, "sub", "a", "x"),
        (at(50), 2, "sub", "a", "x"),
        (at(0), 3, "sub", "b", "x"),
        (at(60), 4, "sub", "c", "x"),
        (at(61), 5, "unsub", "c", "x"),
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    states = {r["client_id"]: r["state"] for r in lease_status(log, at(100), TTL).collect()}
    assert states == {"a": "live", "b": "expired", "c": "deleted"}  # b ends exactly now
    gone = reconcile(current_leases(log.where("op = 'sub'")), live_leases(log, at(100), TTL))
    assert {r["client_id"] for r in gone.collect()} == {"b", "c"}


def test_numbering_has_no_gaps(spark, pieces):
    df = spark.range(500).selectExpr("id * 7 % 500 AS k")
    got = ordered.numbered(df, ["k"], "n", first=10).collect()
    assert sorted((r["k"], r["n"]) for r in got) == [(k, k + 10) for k in range(500)]


def test_lookup_with_and_without_broadcast(spark):
    rows = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    reference = spark.range(0, 300, 2).selectExpr("id AS k", "id * 10 AS v")
    small = ordered.lookup(rows, reference, ["k"], ["id"])
    large = ordered.lookup(rows, reference, ["k"], ["id"], broadcast_limit=0)
    assert sorted(map(tuple, small.select("id", "k", "v").collect())) == sorted(map(tuple, large.select("id", "k", "v").collect()))
    assert large.count() == 300


def walk(records):
    by_id, by_text, kept = {}, {}, {}
    for key, sub_id, expression, created in sorted(records, key=lambda r: (r[3], r[0])):
        ok = by_text.get(expression, sub_id) == sub_id and by_id.get(sub_id, expression) == expression
        if ok:
            by_id[sub_id], by_text[expression] = expression, sub_id
        kept[key] = ok
    return kept


@pytest.mark.parametrize(("seed", "one_group"), [(5, 20_000), (6, 0)])
def test_restore_conflicts(spark, seed, one_group, monkeypatch):
    monkeypatch.setattr(subscriptions, "ONE_GROUP", one_group)
    r = random.Random(seed)
    records = [(f"k{i}", 0 if r.random() < 0.33 else r.randrange(12), f"e{r.randrange(12)}", r.randrange(100)) for i in range(150)]
    df = spark.createDataFrame(records, "key string, sub_id bigint, expression string, created bigint")
    got = {x["key"]: x["restored"] for x in subscriptions.restore_conflicts(df).collect()}
    assert got == walk(records)


def test_restore_examples(spark):
    records = [("7.a", 7, "e1", 1), ("8.a", 8, "e1", 2), ("7.b", 7, "e2", 3), ("7.c", 7, "e1", 4), ("8.b", 8, "e2", 5)]
    df = spark.createDataFrame(records, "key string, sub_id bigint, expression string, created bigint")
    got = {x["key"]: x["restored"] for x in subscriptions.restore_conflicts(df).collect()}
    assert got == {"7.a": True, "8.a": False, "7.b": False, "7.c": True, "8.b": True}


def test_check_records(spark):
    good = '{"version": 1, "subscription_id": 42, "client_id": "client.abc", "expression": "value > 1"}'
    rows = [
        ("42.client.abc", "put", good, None),
        ("42.client.abc", "del", good, "tombstone"),
        ("42.other", "put", good, "mismatch"),
        ("42junk.client", "put", good, "bad key"),
        ("42.client.abc", "put", good.replace('"version": 1', '"version": 2'), "mismatch"),
        ("42.client.abc", "put", good.replace('"version": 1', '"version": 1, "deleted": true'), "deleted"),
        ("42.client.abc", "put", "{", "bad record"),
        ("42.client.abc", "put", '{"version": 1}', "bad record"),
    ]
    store = spark.createDataFrame(rows, "key string, op string, value string, expected string")
    assert all(r["reason"] == r["expected"] for r in check_records(store).collect())


def test_control_messages(spark):
    rows = [
        (1, "sub", '{"expression": "a > 1", "client_id": "c"}', None),
        (2, "sub", '{"expression": "a > 1"}', "Bad request: client_id"),
        (3, "sub", '{"client_id": "c"}', "Bad request: expression"),
        (4, "sub", '{"expression": 5, "client_id": "c"}', "Bad request: expression"),
        (5, "sub", "nonsense", "Bad request: not JSON"),
        (6, "unsub", '{"id": 3, "client_id": "c"}', None),
        (7, "unsub", '{"id": "3", "client_id": "c"}', "Bad request: id"),
        (8, "unsub", '{"id": -3, "client_id": "c"}', "Bad request: id"),
        (9, "unsub", '{"id": 3}', "Bad request: client_id"),
    ]
    messages = spark.createDataFrame(rows, "seq bigint, op string, payload string, expected string")
    assert all(r["error"] == r["expected"] for r in subscriptions.control_log(messages).collect())


def test_deduplicate_and_remove(spark):
    rows = [(at(0), 1, "sub", "a", "x > 1"), (at(1), 2, "sub", "b", "x > 1"), (at(2), 3, "sub", "a", "x  > 1")]
    found = {r["expression"]: (r["clients"], r["requests"]) for r in subscriptions.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"x > 1": (2, 2), "x  > 1": (1, 1)}  # the text counts, not its meaning
    active = spark.createDataFrame([(1, "x"), (2, "y")], "sub_id bigint, expression string")
    ids = spark.createDataFrame([(2,), (3,), (3,)], "sub_id bigint")
    assert [r["sub_id"] for r in subscriptions.force_remove(active, ids).collect()] == [1]
    assert {tuple(r) for r in subscriptions.force_remove_results(active, ids).collect()} == {(2, True), (3, False)}


def test_a_long_chain_of_conflicts_and_records_without_a_time(spark, monkeypatch):
    monkeypatch.setattr(subscriptions, "ONE_GROUP", 0)
    links = [(f"{i // 2 + i % 2}.c", i // 2 + i % 2, f"value > {i // 2}", i) for i in range(10_000)]
    alone = [(f"{k}.x", k, f"other {k}", None) for k in range(1000, 1010)]
    late = [("2000.a", 2000, "late", None), ("2000.b", 2000, "early", 5)]
    df = spark.createDataFrame([(k, s, e, c) for k, s, e, c in links + alone + late], "key string, sub_id bigint, expression string, created bigint")
    ids, texts = {}, {}
    for _, s, e, c in sorted(links + alone + late, key=lambda x: (x[3] is None, x[3] or 0, x[0])):
        if ids.get(s, e) == e and texts.get(e, s) == s:
            ids[s], texts[e] = e, s
    want = {(s, e): ids.get(s) == e for _, s, e, _ in links + alone + late}
    got = {(x["sub_id"], x["expression"]): x["restored"] for x in subscriptions.restore_conflicts(df).collect()}
    assert got == want and got[(2000, "early")] and not got[(2000, "late")]


def test_only_the_last_record_of_a_key_counts(spark):
    rows = [("1.a", "put", "x", 1), ("1.a", "del", None, 3), ("2.b", "put", "y", 2), ("2.b", "put", "z", None)]
    df = spark.createDataFrame(rows, "key string, op string, value string, created bigint")
    assert {tuple(x) for x in latest_records(df).collect()} == {("1.a", "del", None, 3), ("2.b", "put", "z", None)}


def test_replies_name_what_was_asked_for(spark):
    rows = [(1, "unsub", 7, None, "not_found"), (2, "unsub", 3, 3, "still_active"), (3, "sub", None, 4, None)]
    df = spark.createDataFrame(rows, "seq bigint, op string, id bigint, sub_id bigint, outcome string")
    assert {tuple(x) for x in subscriptions.unsubscribe_replies(df).collect()} == {(1, 7, True), (2, 3, False)}
    messages = spark.createDataFrame([(1, "sub", "{"), (2, "sub", '{"expression": "a = 1", "client_id": "c"}')], "seq bigint, op string, payload string")
    assert [tuple(x) for x in subscriptions.error_replies(subscriptions.control_log(messages)).collect()] == [(1, "Bad request: not JSON")]


def test_components_of_chains_take_few_rounds(spark, monkeypatch):
    rounds, uneven = [], graph.uneven_join
    monkeypatch.setattr(graph, "uneven_join", lambda *a, **b: rounds.append(1) or uneven(*a, **b))
    monkeypatch.setattr(graph, "FREQUENT_ROWS", 5)
    r = random.Random(1)
    names = list(range(6000))
    r.shuffle(names)
    # A chain in any order, a star, and a pair.
    edges = list(zip(names[:4000], names[1:4000], strict=False)) + [(names[4000], n) for n in names[4001:5900]] + [(names[5998], names[5999])]
    labels = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parts = [names[:4000], names[4000:5900], names[5998:]]
    assert labels == {n: min(p) for p in parts for n in p}
    assert len(rounds) <= 2 * 14

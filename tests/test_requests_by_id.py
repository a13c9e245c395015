"""Requests that name subscriptions by id, and snapshots, against a step-by-step simulation."""

import json
import random
from datetime import datetime, timedelta

import pytest

from fansieve.operators import control, snapshots, subscriptions

TTL = 100
START = datetime(2024, 1, 1)
LOG = "ts timestamp_ntz, seq bigint, op string, client_id string, expression string, id bigint"


def at(seconds):
    return START + timedelta(seconds=seconds)


def random_requests(seed, n):
    """Requests with ids that are right, stale, from other subscriptions or not yet given."""
    r, rows, now, given = random.Random(seed), [], 0, 1
    for seq in range(n):
        now += r.choice([0, 0, 1, 2, 5, 20, TTL])
        client = "c0" if r.random() < 0.33 else f"c{r.randrange(5)}"
        if r.random() < 0.45:
            rows.append((at(now), seq, "unsub", client, None, r.choice([r.randrange(1, given + 3), max(1, given - r.randrange(4))])))
        else:
            rows.append((at(now), seq, "sub", client, "hot" if r.random() < 0.33 else f"e{r.randrange(6)}", None))
            given += r.random() < 0.4
    return rows


def simulate(rows, state=None):
    """A server that handles one request after the other: answers, and its state (holds by expression, ids, next id)."""
    holds, ids, next_id = state or ({}, {}, 1)
    holds, ids = {e: dict(h) for e, h in holds.items()}, dict(ids)
    answers = {}
    for ts, seq, op, client, expression, sub_id in rows:
        for e in list(holds):
            holds[e] = {c: t for c, t in holds[e].items() if t + timedelta(seconds=TTL) > ts}
            if not holds[e]:
                del holds[e], ids[e]
        if op == "sub":
            if expression not in holds:
                holds[expression], ids[expression] = {}, next_id
                next_id += 1
            holds[expression][client] = ts
            answers[seq] = (ids[expression], None, expression)
            continue
        named = next((e for e, i in ids.items() if i == sub_id), None)
        if named is None:
            answers[seq] = (None, "not_found", None)
            continue
        holds[named].pop(client, None)
        left = bool(holds[named])
        if not left:
            del holds[named], ids[named]
        answers[seq] = (sub_id, "still_active" if left else "fully_removed", named)
    return answers, (holds, ids, next_id)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def held(snapshot):
    return {(r["sub_id"], r["expression"], r["client_id"], r["ts"]) for r in snapshot.holds.collect()}


def want_held(state, as_of):
    return {(state[1][e], e, c, t) for e, h in state[0].items() for c, t in h.items() if t + timedelta(seconds=TTL) > as_of}


def told(requests):
    return {r["seq"]: (r["sub_id"], r["outcome"], r["expression"]) for r in requests.collect()}


@pytest.mark.parametrize(("seed", "chunk"), [(1, 500_000), (2, 110)])
def test_requests_by_id(spark, seed, chunk):
    rows = random_requests(seed, 300)
    answers, state = simulate(rows)
    outcomes = {a[1] for a in answers.values()}
    assert outcomes == {None, "not_found", "still_active", "fully_removed"}
    requests, after = control.settle(frame(spark, rows), TTL, chunk=chunk)
    assert told(control.with_expression(requests)) == answers
    assert after.next_id == state[2] and held(after) == want_held(state, rows[-1][0])


def test_settling_goes_on_from_a_snapshot(spark):
    rows = random_requests(3, 300)
    first = [r for r in rows if r[0] <= rows[150][0]]
    rest = rows[len(first) :]
    answers, state = simulate(rows)
    _, middle = control.settle(frame(spark, first), TTL, chunk=100)
    requests, after = control.settle(frame(spark, rest), TTL, middle, chunk=100)
    assert told(control.with_expression(requests, middle)) == {r[1]: answers[r[1]] for r in rest}
    assert after.next_id == state[2] and held(after) == want_held(state, rows[-1][0])
    nothing, same = control.settle(frame(spark, []), TTL, after)
    assert nothing.collect() == [] and same is after


def test_replies(spark):
    rows = random_requests(4, 200)
    r = random.Random(5)
    messages, good, expected = [], [], {}
    for ts, seq, op, client, expression, sub_id in rows:
        body = {"client_id": client} | ({"expression": expression} if op == "sub" else {"id": sub_id})
        to = None if r.random() < 0.2 else f"reply-{seq}"
        fault = r.random()
        if fault < 0.1:
            missing = "client_id" if fault < 0.04 else "expression" if op == "sub" else "id"
            messages.append((ts, seq, op, json.dumps({k: v for k, v in body.items() if k != missing}), to, "x"))
            if to:
                expected[seq] = (None, None, f"Bad request: {missing}")
        elif fault < 0.13:
            messages.append((ts, seq, op, "{", to, "x"))
            if to:
                expected[seq] = (None, None, "Bad request: not JSON")
        else:
            messages.append((ts, seq, op, json.dumps(body), to, "x"))
            if op == "sub" and expression in ("e1", "e2"):
                if to:
                    expected[seq] = (None, None, "Invalid expression: " + ("no such attribute" if expression == "e1" else "unknown expression"))
            elif op == "unsub" or to:
                good.append((ts, seq, op, client, expression, sub_id))
    answers, state = simulate(good)
    to_all = {m[1]: m[4] for m in messages}
    for _, seq, op, _, _, sub_id in good:
        if to_all[seq]:
            expected[seq] = (answers[seq][0], None, None) if op == "sub" else (sub_id, answers[seq][1] != "still_active", None)
    # The definition of one text is there twice.
    texts = [(f"e{k}", "no such attribute" if k == 1 else None) for k in (0, 1, 3, 4, 5)] + [("hot", None), ("hot", None)]
    definitions = spark.createDataFrame(texts, "expression string, reason string")
    df = spark.createDataFrame(messages, "ts timestamp_ntz, seq bigint, op string, payload string, reply_to string, key string")
    replies, _, after = control.control_replies(df, definitions, "out", "bucket", TTL, chunk=64)
    got = replies.collect()
    assert len(got) == len(expected)
    assert {x["seq"]: (x["id"], x["removed"], x["error"]) for x in got} == expected
    assert all(x["reply_to"] == to_all[x["seq"]] for x in got)
    subs = {s: c for _, s, op, c, _, _ in good if op == "sub"}
    accepted = [x for x in got if x["topic"]]
    assert {x["seq"] for x in accepted} == {s for s in subs if to_all[s]}
    assert all((x["topic"], x["lease_key"], x["lease_ttl_seconds"]) == (f"out.{x['id']}", f"{x['id']}.{subs[x['seq']]}", TTL) for x in accepted)
    assert after.next_id == state[2]


def by_expression(rows):
    """The same kind of log with removals that carry the expression."""
    r = random.Random(9)
    return [(ts, seq, op, c, e or r.choice(["hot", "e0", "e1", "e2"]), None) for ts, seq, op, c, e, _ in rows]


def test_snapshot_and_tail_equal_the_whole_log(spark, tmp_path):
    rows = by_expression(random_requests(6, 300))
    log = frame(spark, rows)
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.latest().as_of is None
    for cut in (0, 40, 41, 150, 299):
        as_of = rows[cut][0]
        found = store.at(log, as_of, TTL)
        whole = {(x["sub_id"], x["expression"], x["topic"]) for x in subscriptions.active_subscriptions(log, as_of, TTL, "out").collect()}
        assert {(x["sub_id"], x["expression"], x["topic"]) for x in found.active("out").collect()} == whole
        holders = {(x["sub_id"], x["expression"], x["client_id"]) for x in subscriptions.holders(log, as_of, TTL).collect()}
        assert {h[:3] for h in held(found)} == holders
        seen = log.where(f"ts <= TIMESTAMP_NTZ'{as_of}'")
        assert found.next_id == subscriptions.next_id(subscriptions.assign_ids(subscriptions.incarnations(seen, TTL))).first()["next_id"]
    # Earlier moments come from earlier versions.
    back = store.latest(rows[100][0])
    assert back.as_of == rows[41][0]


def test_only_the_tail_is_scanned(spark, tmp_path):
    rows = by_expression(random_requests(7, 200))
    path = str(tmp_path / "log")
    frame(spark, rows).write.parquet(path)
    log = spark.read.parquet(path)
    first = snapshots.advance(snapshots.empty(spark), log, rows[100][0], TTL)
    plan = snapshots.tail_of(log, first, rows[199][0])._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThan(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_a_writer_that_failed_leaves_nothing_to_read(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    first = store.save(snapshots.Snapshot(spark.createDataFrame([(1, "e", "c", at(0), 1)], snapshots.HOLDS), 2, at(5)))
    # Holds without a listed version.
    first.holds.write.parquet(str(tmp_path / "holds" / "lost"))
    again = snapshots.SnapshotStore(spark, str(tmp_path)).latest()
    assert (again.next_id, again.as_of, again.holds.count()) == (2, at(5), 1)

"""Random events and subscriptions: the join against plain filters, for every way to run it."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fansieve.functions.predicates import CLAUSES_TYPE, InvalidPredicate, attr
from fansieve.operators import match as match_module
from fansieve.operators.match import active_only, fan_out, match, match_ids, unmatched

SCHEMA = "event_id bigint, a bigint, b string, c double, d boolean, e array<bigint>, f array<string>, g bigint"
LETTERS = "pqrstuvw"


def random_events(r, n):
    def maybe(value):
        return None if r.random() < 0.15 else value

    special = [float("inf"), float("-inf"), float("nan"), -0.0, 0.0, 1e300]
    return [
        (
            i,
            maybe(r.randrange(30)),
            # One value holds a third of all rows.
            maybe("p" if r.random() < 0.33 else r.choice(LETTERS)),
            maybe(r.choice(special) if r.random() < 0.05 else round(r.uniform(-50, 150), 1)),
            maybe(r.random() < 0.5),
            maybe([r.randrange(8) for _ in range(r.randrange(4))]),
            maybe([r.choice(LETTERS) for _ in range(r.randrange(4))]),
            maybe(r.randrange(1000)),
        )
        for i in range(n)
    ]


def random_test(r):
    number, text = attr(r.choice("ag")), attr("b")
    size = 30 if number.name == "a" else 1000
    low = r.randrange(size)
    return r.choice(
        [
            lambda: number == low,
            lambda: number != low,
            lambda: (number > low) & (number <= low + r.randrange(1, size)),
            lambda: number < low,
            lambda: number.isin(*(r.randrange(size) for _ in range(3))),
            lambda: number.not_in(*(r.randrange(size) for _ in range(3))),
            lambda: text == r.choice(LETTERS),
            lambda: text != r.choice(LETTERS),
            lambda: text.isin(*r.sample(LETTERS, 2)),
            lambda: attr("c") >= round(r.uniform(-50, 150), 1),
            lambda: (attr("c") > low / 2) & (attr("c") < low / 2 + 7),
            lambda: attr("c") == 0.0,
            lambda: attr("d").is_true(),
            lambda: ~attr("d").is_true(),
            lambda: attr("e").one_of(*r.sample(range(8), 3)),
            lambda: attr("e").all_of(*r.sample(range(8), 2)),
            lambda: attr("e").none_of(*r.sample(range(8), 2)),
            lambda: attr("f").one_of(*r.sample(LETTERS, 2)),
            lambda: attr("f").is_empty(),
            lambda: attr("f").is_not_empty(),
            lambda: text.is_null(),
            lambda: attr("g").is_not_null(),
        ]
    )()


def random_predicate(r):
    out = random_test(r)
    for _ in range(r.randrange(4)):
        other = random_test(r)
        out = out & other if r.random() < 0.7 else out | other
    return ~out if r.random() < 0.15 else out


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(7)
    events = spark.createDataFrame(random_events(r, 400), SCHEMA).cache()
    predicates = [random_predicate(r) for _ in range(150)]
    rows = [(i, p.clauses()) for i, p in enumerate(predicates)]
    subscriptions = spark.createDataFrame(rows, f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}").cache()
    hits = events.select("event_id", F.array(*(F.coalesce(p.column(), F.lit(False)) for p in predicates)).alias("m"))
    expected = {(row["event_id"], i) for row in hits.collect() for i, m in enumerate(row["m"]) if m}
    return events, subscriptions, expected


def pairs(df):
    got = [(r["event_id"], r["sub_id"]) for r in df.select("event_id", "sub_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(
    "options", [{}, {"broadcast_limit": 0}, {"bins": 1}, {"bins": 4}, {"strategy": "compiled"}], ids=str
)
def test_same_as_filters(case, options):
    events, subscriptions, expected = case
    assert pairs(match(events, subscriptions, **options)) == expected


def test_rare_paths_are_shortened(case, monkeypatch):
    events, subscriptions, expected = case
    monkeypatch.setattr(match_module, "MAX_PATHS", 3)
    assert pairs(match(events, subscriptions)) == expected


def test_many_clauses(spark, case):
    events, _, _ = case
    predicate = attr("a") == 0
    for i in range(1, 40):
        predicate = predicate | ((attr("a") == i % 30) & (attr("g") > 25 * i))
    table = spark.createDataFrame([(1, predicate.clauses())], f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}")
    expected = {r["event_id"] for r in events.where(predicate.column()).collect()}
    assert {e for e, _ in pairs(match(events, table, strategy="template"))} == expected


def test_shapes_of_the_result(case):
    events, subscriptions, expected = case
    ids = {r["event_id"]: r["ids"] for r in match_ids(events, subscriptions).collect()}
    assert ids == {e: sorted(s for x, s in expected if x == e) for e in range(400)}
    rest = {r["event_id"] for r in unmatched(events, subscriptions).collect()}
    assert rest == {e for e in range(400) if not ids[e]}
    assert {r["topic"] for r in fan_out(events, subscriptions, "out").select("topic").collect()} == {f"out.{s}" for _, s in expected}
    active = subscriptions.where("sub_id < 10").select("sub_id")
    assert pairs(match(events, active_only(subscriptions, active))) == {(e, s) for e, s in expected if s < 10}


@pytest.mark.parametrize("options", [{}, {"bins": 1}, {"broadcast_limit": 0}], ids=str)
def test_unmatched_without_lists(spark, case, options):
    events, _, _ = case
    r = random.Random(11)
    predicates = [(attr("a") == r.randrange(30)) & (attr("g") > r.randrange(1000)) & attr("b").is_not_null() for _ in range(40)]
    predicates += [(attr("c") > x) & (attr("c") <= x + 4) & (attr("b") != "p") for x in range(-50, 150, 10)]
    table = spark.createDataFrame([(i, p.clauses()) for i, p in enumerate(predicates)], f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}")
    expected = {e for e in range(400)} - {e for e, _ in pairs(match(events, table))}
    got = [x["event_id"] for x in unmatched(events, table, **options).collect()]
    assert sorted(got) == sorted(expected) and expected
    few = {x["event_id"] for x in unmatched(events, table.where("sub_id < 5")).collect()}
    assert few == {e for e in range(400)} - {e for e, _ in pairs(match(events, table.where("sub_id < 5")))}


def test_undecodable_events_have_no_ids(case):
    events, subscriptions, expected = case
    marked = events.withColumn("ok", F.col("event_id") >= 5)
    ids = {r["event_id"]: r["ids"] for r in match_ids(marked, subscriptions, decodable="ok").collect()}
    assert [ids[i] for i in range(5)] == [None] * 5
    assert ids[5] == sorted(s for x, s in expected if x == 5)


def test_no_subscriptions(case):
    events, subscriptions, _ = case
    none = match(events, subscriptions.where("false"))
    assert none.columns == [*events.columns, "sub_id"] and none.isEmpty()
    assert unmatched(events, subscriptions.where("false")).count() == 400


def test_arguments(case):
    events, subscriptions, _ = case
    with pytest.raises(ValueError):
        match(events, subscriptions, strategy="other")
    with pytest.raises(ValueError):
        match(events, subscriptions.withColumn("a", F.lit(1)))
    with pytest.raises(ValueError):
        fan_out(events, subscriptions, "")


def table_of(spark, predicates):
    return spark.createDataFrame([(i, p.clauses()) for i, p in enumerate(predicates)], f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}")


WAYS = [{"strategy": "template"}, {"strategy": "template", "broadcast_limit": 0}, {"strategy": "compiled"}, {}]


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 30_000}, {"broadcast_limit": 0}], ids=str)
def test_long_lists_have_their_literals_once(spark, case, options, monkeypatch):
    events, _, _ = case
    r = random.Random(3)
    predicates = [attr("g").isin(*r.sample(range(1000), 300)) & (attr("a") > r.randrange(30)) for _ in range(40)]
    predicates += [attr("e").one_of(*r.sample(range(200), 100)) & attr("g").isin(*r.sample(range(1000), 500)) for _ in range(10)]
    plans = []
    made = match_module._plan
    monkeypatch.setattr(match_module, "_plan", lambda *a: plans.append(made(*a)) or plans[-1])
    hits = events.select("event_id", F.array(*(F.coalesce(p.column(), F.lit(False)) for p in predicates)).alias("m")).collect()
    expected = {(row["event_id"], i) for row in hits for i, m in enumerate(row["m"]) if m}
    assert pairs(match(events, table_of(spark, predicates), **options)) == expected and expected
    (plan,) = plans
    facts, keys = plan.facts, plan.clause_side.count()
    assert plan.literal_side.count() == 50
    # The decision rests on the sizes that there are: 17,000 narrow key rows and 50 rows with some hundred literals each.
    assert facts.key_bytes == keys * match_module.KEY_BYTES and 16_000 < keys < 18_000
    held = 8 * sum(len(t.literal) for p in predicates for c in p.dnf() for t in c if isinstance(t.literal, list))
    assert held / 2 < facts.literal_bytes < 6 * held
    assert plan.fits_broadcast == (not options)


@pytest.mark.parametrize("options", WAYS, ids=str)
def test_columns_may_have_any_name(spark, options):
    names = ["_k", "_p", "_s", "_v", "_probe", "_key", "e0", "r0", "_position", "_a0", "a b"]
    events = spark.createDataFrame([(1, *range(5, 16)), (2, *[0] * 11)], "event_id bigint, " + ", ".join(f"`{n}` bigint" for n in names))
    predicates = [attr(n) == 5 + i for i, n in enumerate(names)] + [attr("_k") > 100 + k for k in range(30)]
    subscriptions = table_of(spark, predicates).withColumn("_c", F.col("sub_id"))
    found = match(events, subscriptions, **options)
    assert found.columns == [*events.columns, "sub_id", "_c"]
    assert sorted((x["event_id"], x["sub_id"], x["_c"], x["_k"]) for x in found.collect()) == [(1, i, i, 5) for i in range(len(names))]


@pytest.mark.parametrize("options", WAYS, ids=str)
def test_declared_types_mean_the_same_in_every_strategy(spark, options):
    events = spark.createDataFrame([(1, 12, 12.7), (2, 13, 12.0)], "event_id bigint, n int, x double")
    events = events.withColumn("amount", F.col("x").cast("decimal(10,2)"))
    declared = {"n": "float", "x": "float", "amount": "float"}
    predicates = [attr("n") == 12.0, attr("x") == 12, attr("amount") > 12.5, attr("n") > 12.5]
    found = match(events, table_of(spark, predicates), declared, **options)
    assert pairs(found) == {(1, 0), (2, 1), (1, 2), (2, 3)}
    for wrong in ({"x": "integer"}, {"n": "string"}, {"nope": "integer"}):
        with pytest.raises(ValueError):
            match(events, table_of(spark, predicates), wrong, **options)


@pytest.mark.parametrize("limits", [(30, 8, 1 << 28), (0, 8, 1 << 28), (0, 0, 1 << 28), (0, 8, 0)], ids=str)
def test_keys_that_are_null_or_repeated(spark, monkeypatch, limits):
    few, anti_joins, limit = limits
    monkeypatch.setattr(match_module, "FEW_CLAUSES", few)
    monkeypatch.setattr(match_module, "MAX_ANTI_JOINS", anti_joins)
    rows = [(None, "a"), (7, "a"), (7, "b"), (8, "c"), (None, "b"), (8, "c"), (9, None)]
    events = spark.createDataFrame(rows, "event_id bigint, kind string")
    subscriptions = table_of(spark, [attr("kind") == "a", attr("kind").isin("a", "d")])
    left = [tuple(x) for x in unmatched(events, subscriptions, broadcast_limit=limit).collect()]
    assert sorted(left, key=str) == sorted([(7, "b"), (8, "c"), (None, "b"), (8, "c"), (9, None)], key=str)
    ids = [(x["event_id"], x["ids"]) for x in match_ids(events, subscriptions, broadcast_limit=limit).collect()]
    assert sorted(ids, key=str) == sorted([(None, [0, 1]), (7, [0, 1]), (7, []), (8, []), (None, []), (8, []), (9, [])], key=str)


def test_texts(spark, case):
    events, _, _ = case
    texts = spark.createDataFrame([(1, "a > 20 and b like 'p%'"), (2, "size(e) = 2")], "sub_id bigint, expression string")
    want = {(x[0], s) for s, t in ((1, "a > 20 and b like 'p%'"), (2, "size(e) = 2")) for x in events.where(t).select("event_id").collect()}
    assert pairs(match(events, texts)) == pairs(match(events, texts, strategy="compiled")) == want
    assert {x["event_id"] for x in unmatched(events, texts).collect()} == set(range(400)) - {e for e, _ in want}
    with pytest.raises(ValueError):
        match(events, texts, strategy="template")


def test_rejects_are_returned(spark):
    subscriptions = table_of(spark, [attr("a") == 1, attr("nope") == 1, attr("b") > 2])
    rejects = match_module.rejected_subscriptions(subscriptions, {"a": "integer", "b": "string"})
    assert {x["sub_id"]: x["reason"] for x in rejects.collect()}.keys() == {1, 2}


def test_a_normal_form_has_a_limit():
    predicate = (attr("a") == 0) | (attr("b") == 0)
    for i in range(1, 20):
        predicate = predicate & ((attr("a") == i) | (attr("b") == i))
    with pytest.raises(InvalidPredicate):
        predicate.clauses()
    assert " OR " in predicate.sql()


def captured(monkeypatch):
    plans, made = [], match_module._plan
    monkeypatch.setattr(match_module, "_plan", lambda *a: plans.append(made(*a)) or plans[-1])
    return plans


def test_states_are_access_keys(spark, case, monkeypatch):
    events, _, _ = case
    plans = captured(monkeypatch)
    predicates = [attr("a").is_null() & (attr("b") != "p"), attr("d").is_true() & attr("f").is_empty(), attr("e").is_not_empty() & attr("g").is_null() & (attr("b") != "q")]
    predicates += [attr("b") != "q", attr("b").not_in("p", "q"), attr("e").none_of(1, 2), ~attr("d").is_true() & attr("b").is_not_null()]
    hits = events.select("event_id", F.array(*(F.coalesce(p.column(), F.lit(False)) for p in predicates)).alias("m")).collect()
    expected = {(row["event_id"], i) for row in hits for i, m in enumerate(row["m"]) if m}
    for options in ({}, {"broadcast_limit": 0}):
        assert pairs(match(events, table_of(spark, predicates), strategy="template", **options)) == expected
    paths = {(p.states, p.equal, p.member, p.element) for p in plans[0].access.paths}
    # Only clauses with nothing but exclusions meet every event.
    assert sum(not any(p) for p in paths) == 1 and len(paths) == 5
    ranked = plans[0].clause_side.join(plans[0].clause_side.groupBy("_key").count(), "_key").where("count = 3").select("r0").distinct().collect()
    assert {r["r0"] for r in ranked} == {3, 4, 5}


@pytest.mark.parametrize("filter_keys", [1 << 20, 0])
def test_the_shuffle_join_moves_keys_and_attributes_only(spark, case, monkeypatch, filter_keys):
    events, subscriptions, expected = case
    monkeypatch.setattr(match_module, "FILTER_KEYS", filter_keys)
    wide = events.withColumns({"payload": F.concat(F.lit("p"), F.col("event_id")), "_heavy": F.lit(1)})
    # Repeated and null keys, and rows that are repeated as they are.
    wide = wide.unionByName(wide.where("event_id < 50")).withColumn("event_id", F.expr("nullif(event_id, 7)"))
    attributes = {c: k for c, k in zip("abcdefg", ["integer", "string", "float", "boolean", "integer_list", "string_list", "integer"], strict=True)}
    found = match(wide, subscriptions, attributes, broadcast_limit=0)
    assert found.columns == [*wide.columns, "sub_id"]
    got = Counter((r["payload"], r["sub_id"]) for r in found.collect())
    assert got == Counter({(f"p{e}", s): 2 if e < 50 else 1 for e, s in expected})
    narrow = match_module.match_pairs(wide, subscriptions, attributes, broadcast_limit=0)
    assert "payload" not in narrow.columns and narrow.count() == sum(got.values())


def test_heavy_keys_are_salted_alone(spark, case, monkeypatch):
    events, _, _ = case
    monkeypatch.setattr(match_module, "SAMPLED", 1.0)
    predicates = [(attr("b") == x) & (attr("g") > 30 * i) for x in "pq" for i in range(30)] + [(attr("b") == "z") & (attr("g") == 5)]
    table = table_of(spark, predicates)
    want = pairs(match(events, table, strategy="compiled"))
    salted = match(events, table, strategy="template", broadcast_limit=0)
    assert pairs(salted) == want and want


@pytest.mark.parametrize("lists", [True, False])
def test_ids_without_an_exchange(spark, case, lists):
    events, _, _ = case
    predicates = [(attr("a") == i) & (attr("g") > 20 * i) | (attr("b") == "p") & (attr("g") == i) for i in range(40)]
    predicates += [attr("e").one_of(i, i + 1) | (attr("c") > 10.0 * i) for i in range(8)] if lists else []
    # So many keys that the literals are a table of their own.
    predicates += [attr("g").isin(*range(i, 1000, 3)) & (attr("a") > i) for i in range(20)] if lists else []
    table = table_of(spark, predicates)
    want = {e: [] for e in range(400)}
    for e, s in pairs(match(events, table)):
        want[e].append(s)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (batches, 3):
            # Events go on from one batch to the next.
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            ids = match_ids(events, table, carry=["b"])
            assert {r["event_id"]: r["ids"] for r in ids.collect()} == {e: sorted(s) for e, s in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    assert ids.columns == ["event_id", "b", "ids"]
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "mapinarrow" in plan.lower()
    grouped = match_ids(events, table, carry=["b"], broadcast_limit=0)
    assert {r["event_id"]: r["ids"] for r in grouped.collect()} == {e: sorted(s) for e, s in want.items()}


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}], ids=str)
@pytest.mark.parametrize("collisions", [False, True])
def test_clauses_with_the_same_long_list_share_its_keys(spark, case, options, collisions, monkeypatch):
    events, _, _ = case
    r = random.Random(5)
    plans = captured(monkeypatch)
    if collisions:
        hashed = match_module.Access._hash
        monkeypatch.setattr(match_module.Access, "_hash", staticmethod(lambda *parts: f"pmod({hashed(*parts)}, 3)"))
    numbers = [r.sample(range(1000), 400) for _ in range(3)]
    letters = [[*r.sample(LETTERS, 4), *(f"z{i}{j}" for j in range(60))] for i in range(2)]
    predicates = [attr("g").isin(*numbers[i % 3]) & (attr("c") > 2.5 * i - 50) for i in range(80)]
    predicates += [attr("b").isin(*letters[i % 2]) & (attr("a") > i % 30) | (attr("a") == i) & attr("d").is_true() for i in range(60)]
    hits = events.select("event_id", F.array(*(F.coalesce(p.column(), F.lit(False)) for p in predicates)).alias("m")).collect()
    expected = {(row["event_id"], i) for row in hits for i, m in enumerate(row["m"]) if m}
    assert pairs(match(events, table_of(spark, predicates), **options)) == expected and expected
    # Each list has its keys once, without one for every bin of the ranges; the 60 others are those of `a = i`.
    (plan,) = plans
    assert plan.clause_side.count() == plan.facts.keys == 3 * 400 + 2 * 64 + 60
    assert plan.literal_side.count() == 200 and plan.facts.literal_bytes < 200 * 2_000


def by_filters(events, predicates):
    hits = events.select("event_id", F.array(*(F.coalesce(p.column(), F.lit(False)) for p in predicates)).alias("m")).collect()
    return {(row["event_id"], i) for row in hits for i, m in enumerate(row["m"]) if m}


def test_short_literals_stay_with_their_keys_in_a_shuffle_join(spark, case, monkeypatch):
    events, _, _ = case
    plans = captured(monkeypatch)
    predicates = [(attr("c") > 0.5 * i - 50) & (attr("c") <= 0.5 * i - 20) for i in range(300)]
    expected = by_filters(events, predicates)
    for limit in (1 << 28, 0):
        assert pairs(match(events, table_of(spark, predicates), broadcast_limit=limit)) == expected and expected
    # So many keys that the literals are a table of their own where it is broadcast, but all candidates would be shuffled to meet it otherwise.
    assert [p.literal_side is None for p in plans] == [False, True]
    assert plans[0].facts.keys == plans[1].facts.keys > 4 * 300


@pytest.mark.parametrize("few", [True, False])
def test_pairs_are_not_shuffled_to_meet_other_columns(spark, few):
    r = random.Random(11)
    rows = [(None if i % 50 == 0 else i, r.choice([None, 1, 2]) if few else r.randrange(1000), r.choice(["p", "q", "r", None]), r.choice([True, False, None]), "x" * (i % 7)) for i in range(2000)]
    events = spark.createDataFrame(rows + rows[:40], "event_id bigint, a bigint, b string, d boolean, payload string").cache()
    if few:
        predicates = [attr("a").is_null() & attr("d").is_true() & attr("b").not_in(f"s{i}", "pqr"[i % 3]) for i in range(300)]
    else:
        predicates = [attr("d").is_true() & (attr("a") > i) & (attr("b") != "pqr"[i % 3]) for i in range(300)]
    attributes = {"a": "integer", "b": "string", "d": "boolean"}
    found = match(events, table_of(spark, predicates), attributes, broadcast_limit=60_000 if few else 0)
    assert found.columns == [*events.columns, "sub_id"]
    want = match(events, table_of(spark, predicates), attributes, strategy="compiled")
    count = Counter(tuple(r) for r in found.collect())
    assert count == Counter(tuple(r) for r in want.collect()) and sum(count.values()) > 10 * events.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and ("SortMergeJoin" in plan) != few


@pytest.mark.parametrize("held", [100_000, 20])
def test_clauses_of_a_heavy_key_are_not_repeated_for_every_salt(spark, monkeypatch, held):
    monkeypatch.setattr(match_module, "SAMPLED", 1.0)
    monkeypatch.setattr(match_module, "HELD", held)
    sides, joined = [], match_module._salted_join
    monkeypatch.setattr(match_module, "_salted_join", lambda *a: sides.append((a[0], a[1], joined(*a))) or sides[-1][2])
    r = random.Random(2)
    events = spark.createDataFrame([(i, "p" if i % 4 else r.choice(LETTERS), i) for i in range(200)], "event_id bigint, b string, a bigint").cache()
    predicates = [(attr("b") == "p") & (attr("a") != i) for i in range(500)]
    assert pairs(match(events, table_of(spark, predicates), strategy="template", broadcast_limit=0)) == by_filters(events, predicates)
    ((probing, clauses, out),) = sides
    # All probes that are left have the one key, which has a salt for each half of a task: 16 with 8 tasks.
    copies = out.select("r0", "_ci", "_cj").distinct().groupBy("r0").count().agg(F.max("count")).first()[0]
    assert 1 < copies <= (4 if held > 20 else 8) and clauses.count() == 500 and probing.count() > 150

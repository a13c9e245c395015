"""Subscription texts read by Spark's parser, against plain filters."""

import random

import pytest
from pyspark.sql import functions as F

from fansieve.operators import texts as texts_module
from fansieve.operators.match import match
from fansieve.operators.texts import parse_texts

SCHEMA = "event_id bigint, a bigint, b string, c double, d boolean, e array<bigint>, f array<string>"
KINDS = {"a": "integer", "b": "string", "c": "float", "d": "boolean", "e": "integer_list", "f": "string_list"}

REGULAR = [
    "a = 3", "3 = a", "A > 2 AND c <= 4", "5 > a", "not (a >= 4 or b = 'p')", "b <> 'q'", "a in (1, 2, 7)", "a not in (1, 2)", "b in ('p', 'it''s')", "d", "not d", "d = true",
    "d = false", "a is null", "c is not null", "arrays_overlap(e, array(1, 2))", "arrays_overlap(array('x'), f)", "array_contains(e, 3)", "not array_contains(f, 'y')", "size(e) = 0",
    "array_size(f) > 0", "array_size(array_except(array(1, 2), e)) = 0", "a between 2 and 5", "c > 1.5", "c < -2e0", "c = 3", "`b` = 'p' and (a = 1 or a = 2) and not d",
]
IRREGULAR = ["b like 'p%'", "a + 1 = 4", "a % 2 = 0", "a > 2.5", "a = '3'", "size(e) = 2", "coalesce(a, 0) = 0", "c = a", "year(note) = 2024", "a <=> null"]
INVALID = ["a =", "nope = 1", "a", "a > 'abc'", "b > ", "", "e = 1 and", "sum(a) > 1", "array_contains(nope, 1)", "nope + 1 = 2"]


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(4)

    def maybe(value):
        return None if r.random() < 0.2 else value

    rows = [
        (i, maybe(r.randrange(8)), maybe(r.choice(["p", "q", "it's", "pq"])), maybe(float(r.randrange(-4, 6))), maybe(r.random() < 0.5), maybe([r.randrange(4) for _ in range(r.randrange(4))]),
         maybe([r.choice("xy") for _ in range(r.randrange(3))]))
        for i in range(200)
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("note", F.expr("date_add(DATE'2023-12-31', CAST(event_id % 5 AS int))"))


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sub_id bigint, expression string")


def test_texts_are_told_apart(spark, events):
    texts = [*REGULAR, *IRREGULAR, *INVALID, None, REGULAR[0]]
    read = parse_texts(table_of(spark, texts), KINDS, events.schema, page=7).collect()
    assert len(read) == len(set(texts))
    found = {r["expression"]: (r["clauses"] is not None, r["reason"] is not None) for r in read}
    wrong = {t: found[t] for t in texts if found[t] != ((True, False) if t in REGULAR else (False, t not in IRREGULAR))}
    assert not wrong
    reasons = {r["expression"]: r["reason"] for r in read}
    assert reasons["nope = 1"] == "unknown attribute: nope" and reasons["a"] == "not a predicate" and "SYNTAX" in reasons["a ="]


def test_texts_match_as_filters_do(spark, events):
    texts = REGULAR + IRREGULAR + INVALID
    found = match(events, table_of(spark, texts), KINDS)
    assert found.columns == [*events.columns, "sub_id"]
    want = {(r["event_id"], i) for i, t in enumerate(texts) if t not in INVALID for r in events.where(t).select("event_id").collect()}
    got = [(r["event_id"], r["sub_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({s for _, s in want}) > 30


def test_many_texts_run_as_one_join(spark, events, monkeypatch):
    tried = []
    monkeypatch.setattr(texts_module, "validate_expression", lambda *a: tried.append(a))
    texts = [f"a = {k % 9} and c > {k % 7 - 3} and b <> 'x{k}'" for k in range(10_000)]
    subscriptions = table_of(spark, texts)
    clauses = subscriptions.join(parse_texts(subscriptions, KINDS), "expression").drop("expression")
    assert clauses.where("clauses IS NULL").isEmpty() and not tried
    by_text, by_clause = (match(events, s, KINDS).agg(F.count("*"), F.sum(F.hash("event_id", "sub_id").cast("long"))).first() for s in (subscriptions, clauses.drop("reason")))
    assert by_text == by_clause and by_text[0] > 10_000

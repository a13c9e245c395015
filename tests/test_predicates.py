"""Predicates one by one: what each operator means, undefined attributes, validation."""

import itertools
import operator

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.attributes import AttributeSchemaError, attribute_schema, attributes_of
from fansieve.functions.predicates import CLAUSES_TYPE, InvalidPredicate, Test, attr, invalid_reason
from fansieve.operators.match import match
from fansieve.operators.subscriptions import validate_expression

SCHEMA = attribute_schema(["depth:int", "speed:float", "harbour:str", "moored:bool", "cargo:string_list", "berths:int_list"])
ATTRIBUTES = attributes_of(SCHEMA)
depth, speed, harbour, moored, cargo, berths = map(attr, SCHEMA.names)

COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def generated():
    """(label, predicate, event, does it match): every operator on every kind of attribute, by a plain Python meaning of each.

    Scalars lie below, at and above the literal, or are undefined; lists are empty, without, with one of, or with all of the literals.
    """
    # No two labels are alike, as they become column names.
    for attribute, literal, values in ((depth, 7, (-3, 7, 12)), (speed, 4.25, (4.0, 4.25, 1e9))):
        for op, holds in COMPARE.items():
            for k, value in enumerate((*values, None)):
                yield f"{attribute.name} {op} {k}", Test(attribute.name, op, literal), {attribute.name: value}, value is not None and holds(value, literal)
    for op in ("=", "<>"):
        for k, value in enumerate(("Aden", "Brest", "", None)):
            yield f"harbour {op} {k}", Test("harbour", op, "Brest"), {"harbour": value}, value is not None and COMPARE[op](value, "Brest")
    for value in (True, False, None):
        yield f"moored {value}", moored.is_true(), {"moored": value}, value is True
        yield f"not moored {value}", ~moored.is_true(), {"moored": value}, value is False
    for attribute, literals, values in ((depth, (2, 9), (2, 5)), (harbour, ("Brest", "Cork"), ("Cork", "Dover"))):
        for k, value in enumerate((*values, None)):
            there = None if value is None else value in literals
            yield f"{attribute.name} in {k}", attribute.isin(*literals), {attribute.name: value}, there is True
            yield f"{attribute.name} not in {k}", attribute.not_in(*literals), {attribute.name: value}, there is False
    for attribute, literals, others in ((cargo, ("salt", "tin"), ("wool",)), (berths, (3, 4), (8,))):
        lists = ([], [*others], [literals[0], *others], [*literals, *others], None)
        for k, value in enumerate(lists):
            known, had = value is not None, set(literals) & set(value or ())
            event = {attribute.name: value}
            yield f"{attribute.name} one of {k}", attribute.one_of(*literals), event, known and bool(had)
            yield f"{attribute.name} none of {k}", attribute.none_of(*literals), event, known and not had
            yield f"{attribute.name} all of {k}", attribute.all_of(*literals), event, known and len(had) == 2
            yield f"{attribute.name} empty {k}", attribute.is_empty(), event, known and not value
            yield f"{attribute.name} not empty {k}", attribute.is_not_empty(), event, known and bool(value)
    for attribute, value in zip((depth, speed, harbour, moored, cargo, berths), (1, 1.0, "Aden", False, [], [1]), strict=True):
        for k, v in enumerate((value, None)):
            yield f"{attribute.name} null {k}", attribute.is_null(), {attribute.name: v}, v is None
            yield f"{attribute.name} not null {k}", attribute.is_not_null(), {attribute.name: v}, v is not None
    deep, fast = depth > 5, speed > 2.0
    for d, v in itertools.product((9, 1, None), (3.0, 1.0, None)):
        x, y = None if d is None else d > 5, None if v is None else v > 2.0
        both = False if False in (x, y) else None if None in (x, y) else True
        either = True if True in (x, y) else None if None in (x, y) else False
        event = {"depth": d, "speed": v}
        for label, p, meaning in (("and", deep & fast, both), ("or", deep | fast, either)):
            yield f"{label} {d} {v}", p, event, meaning is True
            yield f"not {label} {d} {v}", ~p, event, meaning is False


# The rest: (label, predicate, event, does it match)
GOLDEN = [
    *generated(),
    # Nested negation, quotes, several tests of one attribute.
    ("not_undefined", ~(depth > 1), {}, False),
    ("ne_undefined", depth != 1, {}, False),
    ("not_in_undefined", depth.not_in(1), {}, False),
    ("none_of_undefined", cargo.none_of("x"), {}, False),
    ("all_of_undefined", cargo.all_of("x"), {}, False),
    ("empty_undefined", cargo.is_empty(), {}, False),
    ("not_empty_undefined", cargo.is_not_empty(), {}, False),
    ("not_empty_true", cargo.is_not_empty(), {"cargo": ["a"]}, True),
    ("one_of_empty", cargo.one_of("x"), {"cargo": []}, False),
    ("none_of_empty", cargo.none_of("x"), {"cargo": []}, True),
    ("all_of_empty", cargo.all_of("x"), {"cargo": []}, False),
    ("not_all_of", ~berths.all_of(1, 2), {"berths": [1, 3]}, True),
    ("not_not", ~~(depth > 1), {"depth": 2}, True),
    ("not_and", ~((depth > 1) & moored.is_true()), {"depth": 0}, True),
    ("or_undefined", (depth > 1) | harbour.is_null(), {}, True),
    ("quotes", harbour == "it's a \\ \"test\"", {"harbour": "it's a \\ \"test\""}, True),
    ("negative_zero", speed == 0.0, {"speed": -0.0}, True),
    ("same_attribute_twice", (depth > 1) & (depth > 5) & (depth != 7) & (depth != 8), {"depth": 6}, True),
    ("two_one_of", berths.one_of(1, 2) & berths.one_of(3, 4), {"berths": [2, 3]}, True),
    ("two_one_of_false", berths.one_of(1, 2) & berths.one_of(3, 4), {"berths": [1, 2]}, False),
    ("contradiction", (depth == 1) & (depth == 2), {"depth": 1}, False),
    ("in_and_in", depth.isin(1, 2) & depth.isin(2, 3), {"depth": 2}, True),
    ("in_and_in_empty", depth.isin(1, 2) & depth.isin(3, 4), {"depth": 2}, False),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, *(e.get(a) for a in SCHEMA.names)) for i, (_, _, e, _) in enumerate(GOLDEN)]
    schema = T.StructType([T.StructField("event_id", T.LongType()), *SCHEMA.fields])
    subscriptions = [(i, p.sql(), p.clauses()) for i, (_, p, _, _) in enumerate(GOLDEN)]
    ddl = f"sub_id bigint, expression string, clauses {CLAUSES_TYPE.simpleString()}"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(subscriptions, ddl)


def test_each_predicate_as_a_filter(golden):
    events, _ = golden
    hits = events.select(*(F.coalesce(p.column(), F.lit(False)).alias(label) for label, p, _, _ in GOLDEN)).collect()
    wrong = [label for i, (label, _, _, expected) in enumerate(GOLDEN) if hits[i][label] != expected]
    assert not wrong


@pytest.mark.parametrize("options", [{"strategy": "template"}, {"strategy": "template", "broadcast_limit": 0}, {"strategy": "compiled"}])
def test_strategies_agree_with_the_filters(golden, options):
    events, subscriptions = golden
    columns = [F.coalesce(p.column(), F.lit(False)) for _, p, _, _ in GOLDEN]
    expected = {(r["event_id"], i) for r in events.select("event_id", F.array(*columns).alias("m")).collect() for i, m in enumerate(r["m"]) if m}
    got = [(r["event_id"], r["sub_id"]) for r in match(events, subscriptions, ATTRIBUTES, **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_many_one_of_on_the_same_list(spark):
    """Events with several elements in common with a subscription are reported once."""
    events = spark.createDataFrame([(1, [1, 2, 3, 3], 5.0), (2, [9], 1.0)], "event_id bigint, xs array<bigint>, v double")
    subscriptions = [(1, (attr("xs").one_of(1, 2, 3)).clauses()), (2, ((attr("xs").one_of(2, 3)) & (attr("v") > 2.0)).clauses()), (3, (attr("xs").one_of(3) | attr("xs").one_of(1) | (attr("v") > 0.0)).clauses())]
    table = spark.createDataFrame(subscriptions, f"sub_id bigint, clauses {CLAUSES_TYPE.simpleString()}")
    got = sorted((r["event_id"], r["sub_id"]) for r in match(events, table, strategy="template").select("event_id", "sub_id").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize(
    "predicate",
    [
        attr("nope") > 1,
        depth > 1.5,
        depth == "x",
        harbour > "a",
        speed.isin(1, 2),
        moored == 1,
        harbour.one_of("x"),
        cargo.isin("x"),
        cargo.one_of(1),
        depth.is_empty(),
        depth > 2**70,
    ],
)
def test_invalid_predicates(spark, predicate):
    with pytest.raises(InvalidPredicate):
        predicate.check(ATTRIBUTES)
    if isinstance(predicate, Test) and predicate.literal == 2**70:
        return  # no such row can exist
    row = spark.createDataFrame([(predicate.clauses(),)], f"clauses {CLAUSES_TYPE.simpleString()}")
    assert row.select(invalid_reason(ATTRIBUTES)).first()[0] is not None


def test_valid_predicates_have_no_fault(golden):
    _, subscriptions = golden
    assert subscriptions.where(invalid_reason(ATTRIBUTES).isNotNull()).isEmpty()
    for _, predicate, _, _ in GOLDEN:
        predicate.check(ATTRIBUTES)


def test_list_literals():
    for values in ([], [1, "x"], [1.5], [True]):
        with pytest.raises(InvalidPredicate):
            depth.isin(*values)


def test_invalid_texts(golden):
    events, _ = golden
    validate_expression(events, "depth > 1 and not moored")
    for text in ("depth >", "nope = 1", "depth + 1", "speed > 'abc'", "depth / 0 = 1"):
        with pytest.raises(InvalidPredicate):
            validate_expression(events, text)


def test_attribute_schema():
    schema = attribute_schema(["a:integer", ("b", "double"), "c:str"])
    assert [f.dataType.simpleString() for f in schema.fields] == ["bigint", "double", "string"]
    for bad in (["a"], ["a:number"], [":int"], [], ["a:int", "a:str"]):
        with pytest.raises(AttributeSchemaError):
            attribute_schema(bad)

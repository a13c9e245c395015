"""Predicates over event attributes.

A predicate has three faces: a Spark ``Column`` for a plain filter, a Spark SQL text for the
subscription table, and a disjunctive normal form (a list of clauses, each a list of elementary
tests) that lets ``match`` join many subscriptions at once.

    p = (attr("value") > 10) & ~attr("symbol").isin("GOOG", "TSLA")
    events.where(p.column())
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.attributes import (
    BOOLEAN,
    FLOAT,
    INTEGER,
    INTEGER_LIST,
    STRING,
    STRING_LIST,
)

# One elementary test. Only the literal field that fits the operator and attribute is set.
TEST_TYPE = T.StructType(
    [
        T.StructField("attribute", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("int", T.LongType()),
        T.StructField("float", T.DoubleType()),
        T.StructField("str", T.StringType()),
        T.StructField("ints", T.ArrayType(T.LongType())),
        T.StructField("strs", T.ArrayType(T.StringType())),
    ]
)
CLAUSES_TYPE = T.ArrayType(T.ArrayType(TEST_TYPE))

# A predicate written out as more clauses than these is refused; its text can still be compiled.
MAX_CLAUSES = 1024

RANGE_OPS = (">", ">=", "<", "<=")
LIST_OPS = ("one of", "none of", "all of")

# Which operators an attribute type accepts, and the field that holds the literal.
_SCALAR_FIELD = {INTEGER: "int", FLOAT: "float", STRING: "str"}
_LIST_FIELD = {INTEGER: "ints", STRING: "strs", INTEGER_LIST: "ints", STRING_LIST: "strs"}
OPERATORS: dict[str, dict[str, str | None]] = {
    BOOLEAN: {"true": None, "false": None},
    INTEGER: {op: "int" for op in ("=", "<>", *RANGE_OPS)} | {"in": "ints", "not in": "ints"},
    FLOAT: {op: "float" for op in ("=", "<>", *RANGE_OPS)},
    STRING: {"=": "str", "<>": "str", "in": "strs", "not in": "strs"},
    STRING_LIST: {op: "strs" for op in LIST_OPS} | {"is empty": None, "is not empty": None},
    INTEGER_LIST: {op: "ints" for op in LIST_OPS} | {"is empty": None, "is not empty": None},
}
for _ops in OPERATORS.values():
    _ops.update({"is null": None, "is not null": None})

_NEGATED = {
    "=": "<>",
    "<": ">=",
    ">": "<=",
    "in": "not in",
    "true": "false",
    "is null": "is not null",
    "is empty": "is not empty",
    "one of": "none of",
}
_NEGATED |= {v: k for k, v in _NEGATED.items()}


class InvalidPredicate(ValueError):
    """A predicate that does not fit the attribute schema."""


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quote_literal(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"double('{value!r}')"
    return str(value)


class Predicate:
    """Base of the predicate tree; combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return self.negated()

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ to combine predicates")

    def negated(self) -> Predicate:
        raise NotImplementedError

    def sql(self, values: Mapping[str, str] | None = None) -> str:
        """Spark SQL text; ``values`` may give the text that stands for an attribute's value."""
        raise NotImplementedError

    def dnf(self) -> list[list[Test]]:
        raise NotImplementedError

    def column(self) -> Column:
        return F.expr(self.sql())

    def clauses(self) -> list[list[dict[str, Any]]]:
        """The disjunctive normal form as rows of ``CLAUSES_TYPE``."""
        return [[test.row() for test in clause] for clause in self.dnf()]

    def check(self, attributes: Mapping[str, str]) -> None:
        """Raise ``InvalidPredicate`` unless every test fits the attribute types."""
        for clause in self.dnf():
            for test in clause:
                test.check_type(attributes)


class Test(Predicate):
    """One attribute, one operator, at most one literal."""

    __test__ = False  # not a pytest class

    def __init__(self, attribute: str, op: str, literal: Any = None):
        if isinstance(literal, (list, tuple, set, frozenset)):
            literal = list(literal)
            if not literal:
                raise InvalidPredicate(f"{attribute} {op}: the literal list is empty")
            if len({type(x) for x in literal}) > 1 or not isinstance(literal[0], (int, str)):
                raise InvalidPredicate(f"{attribute} {op}: list literals are all integers or all strings")
        for item in literal if isinstance(literal, list) else [literal]:
            if isinstance(item, bool):
                raise InvalidPredicate(f"{attribute} {op}: boolean literals are not allowed")
        self.attribute, self.op, self.literal = attribute, op, literal

    def negated(self) -> Predicate:
        if self.op == "all of":
            return reduce(Either, (Test(self.attribute, "none of", [v]) for v in self.literal))
        return Test(self.attribute, _NEGATED[self.op], self.literal)

    def dnf(self) -> list[list[Test]]:
        return [[self]]

    def sql(self, values: Mapping[str, str] | None = None) -> str:
        name, op = (values or {}).get(self.attribute, quote_name(self.attribute)), self.op
        if op == "true":
            return name
        if op == "false":
            return f"(NOT {name})"
        if op in ("is null", "is not null"):
            return f"({name} {op.upper()})"
        if op in ("is empty", "is not empty"):
            return f"(array_size({name}) {'=' if op == 'is empty' else '>'} 0)"
        if not isinstance(self.literal, list):
            return f"({name} {op} {_quote_literal(self.literal)})"
        listed = ", ".join(map(_quote_literal, self.literal))
        if op in ("in", "not in"):
            return f"({name} {op.upper()} ({listed}))"
        cast = "bigint" if isinstance(self.literal[0], int) else "string"
        lits = f"cast(array({listed}) as array<{cast}>)"
        if op == "one of":
            return f"arrays_overlap({name}, {lits})"
        if op == "none of":
            return f"(NOT arrays_overlap({name}, {lits}))"
        return f"(array_size(array_except({lits}, {name})) = 0)"

    def row(self) -> dict[str, Any]:
        out: dict[str, Any] = dict.fromkeys(TEST_TYPE.names)
        out["attribute"], out["op"] = self.attribute, self.op
        if isinstance(self.literal, list):
            out["ints" if isinstance(self.literal[0], int) else "strs"] = self.literal
        elif isinstance(self.literal, str):
            out["str"] = self.literal
        elif self.literal is not None:
            # An integer literal may meet an integer or a float attribute, so it fills both.
            out["float"] = float(self.literal)
            if isinstance(self.literal, int):
                out["int"] = self.literal
        return out

    def check_type(self, attributes: Mapping[str, str]) -> None:
        kind = attributes.get(self.attribute)
        if kind is None:
            raise InvalidPredicate(f"unknown attribute: {self.attribute}")
        if self.op not in OPERATORS[kind]:
            raise InvalidPredicate(f"{self.attribute}: operator '{self.op}' does not apply to {kind}")
        field = OPERATORS[kind][self.op]
        if field is not None and self.row()[field] is None:
            raise InvalidPredicate(f"{self.attribute} {self.op}: the literal does not fit {kind}")
        if field == "int" and not -(2**63) <= self.literal < 2**63:
            raise InvalidPredicate(f"{self.attribute} {self.op}: the literal does not fit 64 bits")


class Both(Predicate):
    def __init__(self, left: Predicate, right: Predicate):
        self.left, self.right = left, right

    def negated(self) -> Predicate:
        return Either(self.left.negated(), self.right.negated())

    def sql(self, values: Mapping[str, str] | None = None) -> str:
        return f"({self.left.sql(values)} AND {self.right.sql(values)})"

    def dnf(self) -> list[list[Test]]:
        left, right = self.left.dnf(), self.right.dnf()
        if len(left) * len(right) > MAX_CLAUSES:
            raise InvalidPredicate(f"more than {MAX_CLAUSES} clauses: use a text and the compiled strategy")
        return [a + b for a in left for b in right]


class Either(Predicate):
    def __init__(self, left: Predicate, right: Predicate):
        self.left, self.right = left, right

    def negated(self) -> Predicate:
        return Both(self.left.negated(), self.right.negated())

    def sql(self, values: Mapping[str, str] | None = None) -> str:
        return f"({self.left.sql(values)} OR {self.right.sql(values)})"

    def dnf(self) -> list[list[Test]]:
        return self.left.dnf() + self.right.dnf()


class attr:
    """An attribute reference with one method or operator per predicate."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Test(self.name, "=", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return Test(self.name, "<>", value)

    def __lt__(self, value: Any) -> Predicate:
        return Test(self.name, "<", value)

    def __le__(self, value: Any) -> Predicate:
        return Test(self.name, "<=", value)

    def __gt__(self, value: Any) -> Predicate:
        return Test(self.name, ">", value)

    def __ge__(self, value: Any) -> Predicate:
        return Test(self.name, ">=", value)

    __hash__ = None  # type: ignore[assignment]

    def is_true(self) -> Predicate:
        return Test(self.name, "true")

    def isin(self, *values: Any) -> Predicate:
        return Test(self.name, "in", values)

    def not_in(self, *values: Any) -> Predicate:
        return Test(self.name, "not in", values)

    def is_null(self) -> Predicate:
        return Test(self.name, "is null")

    def is_not_null(self) -> Predicate:
        return Test(self.name, "is not null")

    def is_empty(self) -> Predicate:
        return Test(self.name, "is empty")

    def is_not_empty(self) -> Predicate:
        return Test(self.name, "is not empty")

    def one_of(self, *values: Any) -> Predicate:
        return Test(self.name, "one of", values)

    def none_of(self, *values: Any) -> Predicate:
        return Test(self.name, "none of", values)

    def all_of(self, *values: Any) -> Predicate:
        return Test(self.name, "all of", values)


# --- the same tests for subscription tables computed by Spark -----------------------------------


def _struct(attribute: str, op: str, literal: str | None = None, slot: str | None = None) -> str:
    parts = []
    for f in TEST_TYPE.fields:
        value = {"attribute": _quote_literal(attribute), "op": _quote_literal(op), slot: literal}.get(f.name, "NULL")
        parts.append(f"'{f.name}', CAST({value} AS {f.dataType.simpleString()})")
    return f"named_struct({', '.join(parts)})"


def clauses_of(*clauses: Sequence[tuple]) -> Column:
    """A ``clauses`` column: one of the clauses must hold, all tests of a clause must hold.

    A test is ``(attribute, operator)`` or ``(attribute, operator, literal, slot)``, where the
    literal is a Spark SQL expression over the row and the slot a literal field of ``TEST_TYPE``.
    """
    return F.expr(f"array({', '.join('array(' + ', '.join(_struct(*t) for t in c) + ')' for c in clauses)})")


def sql_list(values) -> str:
    return "(" + ", ".join(_quote_literal(v) for v in values) + ")"


def invalid_reason(attributes: Mapping[str, str], clauses: str = "clauses") -> Column:
    """NULL if every test of the ``clauses`` column fits the attribute types, else the first fault."""
    cases = [f"WHEN coalesce(t.attribute NOT IN {sql_list(attributes)}, true) THEN concat('unknown attribute: ', coalesce(t.attribute, '?'))"]
    for kind in sorted(set(attributes.values())):
        here = f"t.attribute IN {sql_list([n for n, k in attributes.items() if k == kind])}"
        allowed = OPERATORS[kind]
        cases.append(
            f"WHEN {here} AND coalesce(t.op NOT IN {sql_list(allowed)}, true) "
            f"THEN concat(t.attribute, ': operator \\'', coalesce(t.op, '?'), '\\' does not apply to {kind}')"
        )
        for slot in sorted({f for f in allowed.values() if f}):
            bad = f"t.`{slot}` IS NULL"
            if slot in ("ints", "strs"):  # an empty list, or one with a NULL in it, is no literal
                bad += f" OR size(t.`{slot}`) = 0 OR exists(t.`{slot}`, v -> v IS NULL)"
            ops = sql_list([op for op, f in allowed.items() if f == slot])
            cases.append(
                f"WHEN {here} AND t.op IN {ops} AND ({bad}) "
                f"THEN concat(t.attribute, ' ', t.op, ': the literal does not fit {kind}')"
            )
    fault = f"CASE {' '.join(cases)} END"
    return F.expr(
        f"CASE WHEN {clauses} IS NULL OR size({clauses}) = 0 OR exists({clauses}, c -> c IS NULL OR size(c) = 0) "
        f"THEN 'no predicate' "
        f"ELSE try_element_at(filter(transform(flatten({clauses}), t -> {fault}), r -> r IS NOT NULL), 1) END"
    )

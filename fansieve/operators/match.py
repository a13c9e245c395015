"""Matching events against many subscriptions with one join.

``match`` turns every clause of every subscription into a row of literals and gives it *access
keys*: hashes of its equality, membership, list or range-bin literals, or of the states (null,
true, empty) that it asks for. Every event computes the same hashes from its attributes. The join meets on those hashes and checks the full clause as a
residual, so an event meets only the clauses it has a chance to satisfy. All attributes,
operators and subscriptions share one scan of the events and, while the clause table is small
enough to broadcast, no shuffle at all.

No duplicates arise, so no distinct over the output is needed:
  * an event has at most one key in common with a clause, except on list attributes, where only
    the first common element counts;
  * of several clauses of a subscription only the first that holds emits the pair.

The expressions are written as SQL text because building them as ``Column`` objects costs a
driver round trip per operator.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.attributes import (
    FLOAT,
    INTEGER,
    INTEGER_LIST,
    SPARK_TYPES,
    STRING,
    STRING_LIST,
    attributes_of,
)
from fansieve.functions.predicates import RANGE_OPS, invalid_reason, quote_name, sql_list
from fansieve.operators.compiled import any_holds, ids_compiled, match_compiled
from fansieve.session import BROADCAST_BYTES, durable, row_bytes, table_bytes

_LIT = {INTEGER: "`int`", FLOAT: "`float`", STRING: "`str`"}
_LITS = {INTEGER: "ints", STRING: "strs", INTEGER_LIST: "ints", STRING_LIST: "strs"}

# Access paths kept in full; clauses on rarer paths use the first attribute of theirs.
MAX_PATHS = 24
MAX_BINS = 32
FEWEST_BINS = 4
# Clauses that share their other literals before their ranges are binned.
CROWD = 16
# Up to this many clauses, and bytes of them, are cheaper as plain expressions than as a join.
FEW_CLAUSES = 30
FEW_BYTES = 64 * 1024
# Anti joins in a row before one join on the event's attributes is the better plan.
MAX_ANTI_JOINS = 8
# Mean keys per clause from which on keys and literals are tables of their own.
MANY_KEYS = 4
KEY_BYTES = 40
# In a shuffle join literals stay in the key rows up to so many times the bytes of both tables, as all candidates would be shuffled to meet them.
MOST_COPIES = 4
# Mean length of `in` lists from which on clauses with the same list share its keys, if at least so many clauses have each list.
LONG_LIST, SHARERS = 32, 2
# Earlier clauses checked by plain expressions, which stay inside generated code.
MAX_UNROLLED = 4


def _col(name: str) -> Column:
    return F.col(quote_name(name))


def _and(conditions: Sequence[str]) -> str:
    return "(" + " AND ".join(conditions) + ")" if conditions else "true"


# --- a clause as a row of literals --------------------------------------------------------------


class Slots:
    """Which literal columns the clause rows need: at most attributes x operators."""

    def __init__(self, attributes: Mapping[str, str], used: Mapping[str, set[str]], many_one_of: bool):
        self.attributes, self.used, self.many_one_of = attributes, used, many_one_of
        # Event columns may have any name, so all names made here, lambda variables too, start with "_".
        self.names = {a: f"_a{i}" for i, a in enumerate(attributes)}

    def build(self, tests: str) -> dict[str, str]:
        """The literal columns of one clause, computed from its array of tests."""

        def picked(attribute: str, *ops: str) -> str:
            name = sql_list([attribute])
            return f"filter({tests}, _t -> _t.attribute IN {name} AND _t.op IN {sql_list(ops)})"

        def lits(attribute: str, slot: str, *ops: str) -> str:
            return f"transform({picked(attribute, *ops)}, _t -> _t.{slot})"

        def or_null(values: str) -> str:
            return f"nullif({values}, array())"

        out: dict[str, str] = {}
        possible: list[str] = []
        for attribute, ops in self.used.items():
            kind, c = self.attributes[attribute], self.names[attribute]
            for yes, no, slot in (
                ("true", "false", "truth"),
                ("is null", "is not null", "null"),
                ("is empty", "is not empty", "empty"),
            ):
                if ops & {yes, no}:
                    flags = f"transform({picked(attribute, yes, no)}, _t -> _t.op = '{yes}')"
                    out[f"{c}_{slot}"] = f"array_max({flags})"
                    possible.append(f"array_max({flags}) <=> array_min({flags})")
            if "=" in ops:
                values = lits(attribute, _LIT[kind], "=")
                out[f"{c}_eq"] = f"array_max({values})"
                possible.append(f"array_max({values}) <=> array_min({values})")
            for op, slot, pick in ((">", "gt", "max"), (">=", "ge", "max"), ("<", "lt", "min"), ("<=", "le", "min")):
                if op in ops:
                    out[f"{c}_{slot}"] = f"array_{pick}({lits(attribute, _LIT[kind], op)})"
            excluded = []
            if "<>" in ops:
                excluded.append(lits(attribute, _LIT[kind], "<>"))
            if "not in" in ops:
                excluded.append(f"flatten({lits(attribute, _LITS[kind], 'not in')})")
            if excluded:
                out[f"{c}_notin"] = or_null(f"array_distinct(concat({', '.join(excluded)}))")
            if "in" in ops:
                lists = lits(attribute, _LITS[kind], "in")
                common = f"aggregate({lists}, array_distinct(try_element_at({lists}, 1)), (_l, _r) -> array_intersect(_l, _r))"
                out[f"{c}_in"] = common
                possible.append(f"coalesce(size({common}) <> 0, true)")
            if "one of" in ops:
                lists = lits(attribute, _LITS[kind], "one of")
                out[f"{c}_oneof"] = f"try_element_at({lists}, 1)"
                if self.many_one_of:
                    out[f"{c}_oneofs"] = f"nullif(slice({lists}, 2, greatest(size({lists}) - 1, 0)), array())"
            for op, slot in (("none of", "noneof"), ("all of", "allof")):
                if op in ops:
                    out[f"{c}_{slot}"] = or_null(f"array_distinct(flatten({lits(attribute, _LITS[kind], op)}))")
        out["_possible"] = _and(possible)
        return out

    def holds(self, event: Callable[[str], str], clause: Callable[[str], str]) -> str:
        """Whether the clause row accepts the event; NULL (unknown) counts as no."""
        checks: list[str] = []

        def when_set(slot: str, test: str) -> None:
            checks.append(f"({clause(slot)} IS NULL OR {test.format(x=clause(slot))})")

        for attribute, ops in self.used.items():
            c = self.names[attribute]
            v = event(attribute).replace("{", "{{").replace("}", "}}")
            for op, slot in (("=", "eq"), (">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le")):
                if op in ops:
                    when_set(f"{c}_{slot}", f"{v} {op} {{x}}")
            if ops & {"true", "false"}:
                when_set(f"{c}_truth", f"{v} = {{x}}")
            if "in" in ops:
                when_set(f"{c}_in", f"array_contains({{x}}, {v})")
            if ops & {"<>", "not in"}:
                when_set(f"{c}_notin", f"NOT array_contains({{x}}, {v})")
            if ops & {"is null", "is not null"}:
                when_set(f"{c}_null", f"({v} IS NULL) = {{x}}")
            if ops & {"is empty", "is not empty"}:
                when_set(f"{c}_empty", f"(array_size({v}) = 0) = {{x}}")
            if "one of" in ops:
                when_set(f"{c}_oneof", f"arrays_overlap({v}, {{x}})")
                if self.many_one_of:
                    when_set(f"{c}_oneofs", f"forall({{x}}, _list -> arrays_overlap({v}, _list))")
            if "none of" in ops:
                when_set(f"{c}_noneof", f"NOT arrays_overlap({v}, {{x}})")
            if "all of" in ops:
                when_set(f"{c}_allof", f"array_size(array_except({{x}}, {v})) = 0")
        return _and(checks)


# --- access paths -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Path:
    """The attributes an access key is made of."""

    equal: tuple[str, ...] = ()
    member: str | None = None  # scalar attribute with `in`
    element: str | None = None  # list attribute with `one of` or `all of`
    states: tuple[tuple[str, str], ...] = ()  # (attribute, slot): null, true or empty, where there is none of these
    binned: str | None = None  # numeric attribute with a range

    @staticmethod
    def parse(code: str, names: Sequence[str]) -> Path:
        equal, member, element, states, binned = code.split("|")

        def name(position: str) -> str | None:
            return names[int(position)] if position else None

        asked = tuple((names[int(p[:-1])], STATES[p[-1]][0]) for p in states.split(",") if p)
        return Path(tuple(names[int(p)] for p in equal.split(",") if p), name(member), name(element), asked, name(binned))


#: States that an event's attribute is in or not: the literal's slot, and the operators that ask for it.
STATES = {"n": ("null", ("is null", "is not null")), "t": ("truth", ("true", "false")), "e": ("empty", ("is empty", "is not empty"))}


def _path_code(names: Sequence[str], binned: Sequence[str]) -> str:
    """The path of a clause as text: positions of its attributes, ``equal|member|element|states|binned``.

    States are of use where there is nothing better. ``names`` has the most selective attribute first; ``binned`` are the attributes with bins.
    """
    known = f"array{sql_list(names)}"

    def positions(ops: Sequence[str], among: Sequence[str] | None = None) -> str:
        only = "" if among is None else f" AND _t.attribute IN {sql_list(among)}"
        picked = f"filter(_tests, _t -> _t.op IN {sql_list(ops)}{only})"
        return f"array_sort(array_distinct(transform({picked}, _t -> array_position({known}, _t.attribute) - 1)))"

    def first(values: str) -> str:
        return f"coalesce(CAST(array_min({values}) AS string), '')"

    equal, member, element = positions(["="]), first(positions(["in"])), first(positions(["one of", "all of"]))
    member = f"CASE WHEN size({equal}) = 0 THEN {member} ELSE '' END"
    element = f"CASE WHEN size({equal}) = 0 AND {member} = '' THEN {element} ELSE '' END"
    asked = ", ".join(f"transform({positions(ops)}, _p -> concat(CAST(_p AS string), '{letter}'))" for letter, (_, ops) in STATES.items())
    states = f"CASE WHEN size({equal}) = 0 AND {member} = '' AND {element} = '' THEN concat_ws(',', array_sort(concat({asked}))) ELSE '' END"
    ranged = "''"
    if binned:
        lower, upper = positions([">", ">="], binned), positions(["<", "<="], binned)
        both, either = first(f"array_intersect({lower}, {upper})"), first(f"array_union({lower}, {upper})")
        ranged = f"CASE WHEN arrays_overlap({lower}, {upper}) THEN {both} ELSE {either} END"
    return f"concat_ws('|', concat_ws(',', transform({equal}, _p -> CAST(_p AS string))), {member}, {element}, {states}, {ranged})"


def _short_code(binned: bool) -> str:
    """SQL text: the path ``_code`` cut down to one attribute."""
    part = [f"split_part(_code, '|', {i})" for i in (1, 2, 3, 4, 5)]
    ranged = f"WHEN {part[4]} <> '' THEN concat('||||', {part[4]}) " if binned else ""
    return (
        f"CASE WHEN {part[0]} <> '' THEN concat(split_part({part[0]}, ',', 1), '||||') "
        f"WHEN {part[1]} <> '' THEN concat('|', {part[1]}, '|||') "
        f"WHEN {part[2]} <> '' THEN concat('||', {part[2]}, '||') "
        f"{ranged}ELSE concat('|||', split_part({part[3]}, ',', 1), '|') END"
    )


#: A probe that meets nothing.
NO_PROBE = "named_struct('p', -1, 's', CAST(NULL AS string), 'n', CAST(NULL AS bigint))"


class Access:
    """Access keys of clauses and events for a set of paths."""

    def __init__(self, slots: Slots, paths: Sequence[Path], borders: Mapping[str, Sequence[float]], fine: int):
        self.slots, self.paths, self.borders, self.fine = slots, paths, borders, fine

    def _plain(self, attribute: str, value: str) -> str:
        # -0.0 and 0.0 are equal, so they need one hash.
        return f"({value} + 0.0D)" if self.slots.attributes[attribute] == FLOAT else value

    def _cell(self, attribute: str, value: str) -> str:
        """Coarse bin: how many borders lie at or below the value."""
        value = f"CAST({value} AS double)"
        return "(" + " + ".join(["0", *(f"CAST({value} >= double('{b!r}') AS int)" for b in self.borders[attribute])]) + ")"

    def _fine(self, attribute: str, value: str, cell: str) -> str:
        """Fine bin: equal steps between the two borders of the cell, numbered across all cells."""
        borders = self.borders[attribute]
        steps = [(b - a) / self.fine for a, b in zip(borders, borders[1:])]
        lows = ", ".join(f"double('{b!r}')" for b in [borders[0], *borders])
        widths = ", ".join(f"double('{w!r}')" for w in [float("inf"), *steps, float("inf")])
        step = f"try_divide(CAST({value} AS double) - get(array({lows}), {cell}), get(array({widths}), {cell}))"
        # Below the first border and above the last there is one bin. NaN sorts above everything.
        last = len(borders)
        return (
            f"CASE WHEN {cell} = 0 THEN 0 WHEN {cell} = {last} THEN {last * self.fine} "
            f"ELSE {cell} * {self.fine} + CAST(greatest(0D, least({self.fine - 1}D, floor({step}))) AS int) END"
        )

    @staticmethod
    def _hash(i: int, *parts: str) -> str:
        return f"xxhash64({', '.join([str(i), *parts])})"

    def _binned(self) -> list[str]:
        return sorted({path.binned for path in self.paths if path.binned})

    def clause_bins(self) -> list[dict[str, str]]:
        """Columns with the range of bins each clause covers, in the order they build on each other."""
        ends: dict[str, str] = {}
        cells: dict[str, str] = {}
        fines: dict[str, str] = {}
        for a in self._binned():
            c, used, n = self.slots.names[a], self.slots.used[a], len(self.borders[a])
            lows = [f"{c}_{s}" for s, op in (("gt", ">"), ("ge", ">=")) if op in used]
            highs = [f"{c}_{s}" for s, op in (("lt", "<"), ("le", "<=")) if op in used]
            for side, of, pick, open_cell in (("l", lows, "greatest", -1), ("h", highs, "least", n + 1)):
                end = f"{pick}({', '.join(of)})" if len(of) > 1 else (of or ["NULL"])[0]
                ends[f"_{side}{c}"] = f"CAST({end} AS double)"
                # An open end lies beyond the outermost cell, so that all cells up to there are whole.
                cells[f"_{side}c{c}"] = f"CASE WHEN _{side}{c} IS NULL THEN {open_cell} ELSE {self._cell(a, f'_{side}{c}')} END"
                fines[f"_{side}f{c}"] = f"CASE WHEN _{side}{c} IS NOT NULL THEN {self._fine(a, f'_{side}{c}', f'_{side}c{c}')} END"
        return [ends, cells, fines]

    def _range_keys(self, i: int, parts: Sequence[str]) -> str:
        """Keys of the cells a range covers whole, and of the fine bins in the cells it ends in.

        An event meets a range on exactly one of them.
        """
        c = self.slots.names[self.paths[i].binned]
        low, high, low_fine, high_fine = f"_lc{c}", f"_hc{c}", f"_lf{c}", f"_hf{c}"

        def span(start: str, stop: str) -> str:
            return f"CASE WHEN {start} <= {stop} THEN sequence({start}, {stop}) ELSE CAST(array() AS array<int>) END"

        f = self.fine
        inner = span(
            f"greatest({low_fine}, 0)",
            f"CASE WHEN {low} = {high} THEN {high_fine} ELSE {low} * {f} + {f - 1} END",
        )
        outer = span(f"{high} * {f}", f"CASE WHEN {low} <> {high} THEN {high_fine} END")
        whole = f"transform({span(f'{low} + 1', f'{high} - 1')}, _bin -> {self._entry(2 * i, *parts, '_bin')})"
        ends = [
            f"transform(CASE WHEN {low_fine} IS NOT NULL AND {low} <= {high} THEN {inner} ELSE CAST(array() AS array<int>) END, _bin -> {self._entry(2 * i + 1, *parts, '_bin')})",
            f"transform(CASE WHEN {high_fine} IS NOT NULL AND {low} < {high} THEN {outer} ELSE CAST(array() AS array<int>) END, _bin -> {self._entry(2 * i + 1, *parts, '_bin')})",
        ]
        return f"concat({whole}, {', '.join(ends)})"

    def _entry(self, number: int, *parts: str) -> str:
        return f"named_struct('p', {number}, 'k', {self._hash(number, *parts)})"

    def shared_keys(self, i: int, values: str) -> str:
        """The access keys of a list on path ``i``, which has a member and no bins: an array of (p, k) with the literal, as bigint or text."""
        text = self.slots.attributes[self.paths[i].member] == STRING
        s, n = ("_value", "CAST(NULL AS bigint)") if text else ("CAST(NULL AS string)", "_value")
        return f"transform({values}, _value -> named_struct('p', {2 * i}, 'k', {self._hash(2 * i, '_value')}, 's', {s}, 'n', {n}))"

    def same_value(self, shared: Sequence[int], event) -> list[str]:
        """Whether the literal of a shared key is the event's value: keys are hashes, and its clauses do not have the list."""
        checks = []
        for kind, literal in ((STRING, "_key_s"), (INTEGER, "_key_n")):
            cases = [f"WHEN {2 * i} THEN {event(self.paths[i].member)}" for i in shared if self.slots.attributes[self.paths[i].member] == kind]
            if cases:
                checks.append(f"({literal} IS NULL OR {literal} = CASE _p {' '.join(cases)} END)")
        return checks

    def clause_keys(self, i: int) -> str:
        """The access keys of a clause on path ``i``: an array of (p, k)."""
        path, c, used = self.paths[i], self.slots.names, self.slots.used
        fixed = [*(self._plain(a, f"{c[a]}_eq") for a in path.equal), *(f"{c[a]}_{slot}" for a, slot in path.states)]

        def keys(*parts: str) -> str:
            return self._range_keys(i, parts) if path.binned else f"array({self._entry(2 * i, *parts)})"

        values = None
        if path.member:
            values = f"{c[path.member]}_in"
        elif path.element:
            one, every = f"{c[path.element]}_oneof", f"array(array_min({c[path.element]}_allof))"
            # One element stands for `all of`: the event list must hold it.
            has_one, has_every = "one of" in used[path.element], "all of" in used[path.element]
            values = f"coalesce({one}, {every})" if has_one and has_every else one if has_one else every
        if values is None:
            return keys(*fixed)
        entries = f"flatten(transform({values}, _value -> {keys(*fixed, '_value')}))"
        # Distinct by number, as Spark has hash sets of numbers, but compares each struct with each.
        distinct = [f"transform(array_distinct(transform(filter({entries}, _e -> _e.p = {n}), _e -> _e.k)), _k -> named_struct('p', {n}, 'k', _k))" for n in self._numbers(i)]
        return f"concat({', '.join(distinct)})"

    def event_bins(self, event) -> list[dict[str, str]]:
        """The two bins of every binned attribute, computed once per event."""
        cells = {f"_b{self.slots.names[a]}": self._cell(a, event(a)) for a in self._binned()}
        fines = {f"_f{self.slots.names[a]}": self._fine(a, event(a), f"_b{self.slots.names[a]}") for a in self._binned()}
        return [cells, fines]

    def _numbers(self, i: int) -> list[int]:
        """Probe numbers of a path: one, or a coarse and a fine one."""
        return [2 * i, 2 * i + 1] if self.paths[i].binned else [2 * i]

    @staticmethod
    def _usable(path: Path, event) -> str:
        """Whether the event has all that the path's key is made of."""
        needed = [*path.equal, *(a for a in (path.member, path.binned) if a), *(a for a, slot in path.states if slot != "null")]
        return _and([f"{event(a)} IS NOT NULL" for a in dict.fromkeys(needed)])

    def probes(self, event, always: bool = False) -> str:
        """One entry per probe, or per element of a path's list attribute: (p, element as text or bigint).

        With ``always`` there is one more, which has no key, so that every event has a row.
        """
        plain, lists = [NO_PROBE] if always else [], []
        for i, path in enumerate(self.paths):
            usable = self._usable(path, event)
            for number in self._numbers(i):
                if path.element is None:
                    plain.append(f"named_struct('p', CASE WHEN {usable} THEN {number} END, 's', CAST(NULL AS string), 'n', CAST(NULL AS bigint))")
                    continue
                text = self.slots.attributes[path.element] == STRING_LIST
                s, n = ("_x", "CAST(NULL AS bigint)") if text else ("CAST(NULL AS string)", "_x")
                entries = f"transform(array_distinct({event(path.element)}), _x -> named_struct('p', {number}, 's', {s}, 'n', {n}))"
                lists.append(f"CASE WHEN {usable} AND {event(path.element)} IS NOT NULL THEN {entries} ELSE array() END")
        first = f"array({', '.join(plain)})" if plain else "array()"
        return f"concat({', '.join([first, *lists])})" if lists else first

    def _event_hash(self, i: int, number: int, event, element: str | None) -> str:
        path = self.paths[i]
        parts = [self._plain(a, event(a)) for a in path.equal]
        of = {"null": "({v} IS NULL)", "truth": "{v}", "empty": "(array_size({v}) = 0)"}
        parts += [of[slot].replace("{v}", event(a)) for a, slot in path.states]
        if path.member:
            parts.append(event(path.member))
        if path.element:
            parts.append(element)
        if path.binned:
            parts.append(f"_{'f' if number % 2 else 'b'}{self.slots.names[path.binned]}")
        return self._hash(number, *parts)

    def plain_keys(self, event) -> list[tuple[int, str]]:
        """(probe number, key or NULL) of every path; only for paths without list attribute."""
        keys = []
        for i, path in enumerate(self.paths):
            usable = self._usable(path, event)
            keys += [(n, f"CASE WHEN {usable} THEN {self._event_hash(i, n, event, None)} END") for n in self._numbers(i)]
        return keys

    def event_key(self, event) -> str:
        """The access key of one probe."""
        cases = []
        for i, path in enumerate(self.paths):
            element = path.element and ("_s" if self.slots.attributes[path.element] == STRING_LIST else "_v")
            cases += [f"WHEN {n} THEN {self._event_hash(i, n, event, element)}" for n in self._numbers(i)]
        return f"CASE _p {' '.join(cases)} END"

    def first_element_only(self, event, clause) -> list[str]:
        """Of several list elements shared with a `one of`, only the first may emit the pair."""
        checks = []
        for i, path in enumerate(self.paths):
            if path.element and "one of" in self.slots.used[path.element]:
                literals = clause(f"{self.slots.names[path.element]}_oneof")
                element = "_s" if self.slots.attributes[path.element] == STRING_LIST else "_v"
                first = f"try_element_at(array_intersect({event(path.element)}, {literals}), 1)"
                # A clause with a single literal has no second element to share.
                checks.append(f"(_p NOT IN ({2 * i}, {2 * i + 1}) OR {literals} IS NULL OR size({literals}) = 1 OR {first} = {element})")
        return checks


# --- the join -----------------------------------------------------------------------------------


def valid_subscriptions(subscriptions: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """Subscriptions whose clauses fit the attribute schema; the others cannot match anything."""
    return subscriptions.where(invalid_reason(attributes).isNull())


def rejected_subscriptions(subscriptions: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """The subscriptions that ``match`` leaves out, with the ``reason``."""
    return subscriptions.withColumn("reason", invalid_reason(attributes)).where("reason IS NOT NULL")


def _clause_rows(subscriptions: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """One row per clause, with the earlier clauses of its subscription."""
    rest = [c for c in subscriptions.columns if c not in ("clauses", "expression")]
    valid = valid_subscriptions(subscriptions, attributes)
    rows = valid.select(*map(_col, rest), F.col("clauses").alias("_all"), F.posexplode("clauses").alias("_n", "_tests"))
    rows = rows.select(*map(_col, rest), "_tests", F.expr("slice(_all, 1, _n)").alias("_earlier"))
    return rows.withColumn("_bytes", row_bytes(rows))


@dataclass
class Facts:
    """What the plan needs to know about the clauses. Every field is bounded by the schema."""

    used: dict[str, set[str]]
    borders: dict[str, list[float]]
    ranked: list[str]
    codes: list[str]
    clauses: int = 0
    bytes: int = 0
    earlier: int = 0
    one_of: int = 0
    bins: int = 1
    keys: int = 0
    key_bytes: int = 0
    literal_bytes: int = 0
    shared: tuple[int, ...] = ()  # paths on which clauses with the same list share its keys


def _literals(rows: DataFrame, attributes: Mapping[str, str]) -> Facts:
    """Operators in use, borders for bins, and the attributes by how many literals tell clauses apart."""
    shares = ", ".join(str(i / MAX_BINS) for i in range(MAX_BINS + 1))
    tests = rows.select(F.explode("_tests").alias("t")).groupBy("t.attribute", "t.op").agg(
        F.expr(f"percentile_approx(nullif(coalesce(t.`float`, CAST(t.`int` AS double)), double('nan')), array({shares}))").alias("b"),
        F.expr("approx_count_distinct(xxhash64(t.`int`, t.`float`, t.`str`, t.ints, t.strs))").alias("d"),
    )
    used: dict[str, set[str]] = {}
    borders: dict[str, set[float]] = {}
    distinct: dict[str, int] = {}
    for r in sorted(tests.collect(), key=lambda r: (r["attribute"], r["op"])):
        used.setdefault(r["attribute"], set()).add(r["op"])
        if r["op"] in RANGE_OPS and r["b"]:
            borders.setdefault(r["attribute"], set()).update(r["b"])
        elif r["op"] in ("=", "in", "one of", "all of"):
            distinct[r["attribute"]] = max(distinct.get(r["attribute"], 0), r["d"])
    ranked = sorted(attributes, key=lambda a: -distinct.get(a, 0))
    # A single border is not worth binning.
    return Facts(used, {a: sorted(b) for a, b in borders.items() if len(b) > 1}, ranked, [])


def _paths(rows: DataFrame, facts: Facts, bins: int, broadcast_limit: int) -> tuple[DataFrame, Facts]:
    """Add ``_path``, the access path of each clause, and the facts about paths and totals."""
    binned = list(facts.borders) if bins > 1 else []
    member = f"get(array{sql_list(facts.ranked)}, CAST(nullif(split_part(_code, '|', 2), '') AS int))"
    rows = rows.withColumn("_code", F.expr(_path_code(facts.ranked, binned)))
    groups = rows.groupBy("_code").agg(
        F.count("*").alias("n"),
        F.sum("_bytes").alias("bytes"),
        F.expr("max(size(_earlier))").alias("earlier"),
        F.expr("max(size(filter(_tests, _t -> _t.op = 'one of')))").alias("one_of"),
        F.expr("approx_count_distinct(xxhash64(filter(_tests, _t -> _t.op IN ('=', 'in', 'one of', 'all of'))))").alias("d"),
        F.expr(f"avg(array_min(transform(filter(_tests, _t -> _t.op = 'in' AND _t.attribute = {member}), _t -> coalesce(array_size(_t.ints), array_size(_t.strs)))))").alias("listed"),
    )
    top = total = groups.limit(MAX_PATHS + 1).collect()
    rare = len(top) > MAX_PATHS
    if rare:
        top = groups.orderBy(F.desc("n"), "_code").limit(MAX_PATHS).collect()
        total = groups.agg(
            *(F.expr(f"{f}({c}) AS {c}") for f, c in (("sum", "n"), ("sum", "bytes"), ("max", "earlier"), ("max", "one_of")))
        ).collect()
    facts.clauses, facts.bytes = sum(r["n"] for r in total), sum(r["bytes"] for r in total)
    facts.earlier, facts.one_of = max(r["earlier"] for r in total), max(r["one_of"] for r in total)

    # Bins cost copies of the clause, so they are for paths whose other literals leave many together.
    # Long lists that clauses share have no bins either: each literal would have as many keys as the range.
    shared = {r["_code"] for r in top if (r["listed"] or 0) > LONG_LIST and r["n"] >= SHARERS * r["d"]}
    crowded = {r["_code"] for r in top if not r["_code"].endswith("|") and (r["_code"].startswith("|||") or r["n"] > CROWD * r["d"])} - shared
    single = sum(r["bytes"] for r in top if r["_code"] not in crowded)
    # A range has about `bins` keys. Fewer bins if that makes the copies fit the broadcast; a clause
    # table too large for it anyway keeps them all, as a shuffle join without bins meets every range.
    facts.bins = bins if crowded or (rare and binned) else 1
    fitting = facts.bins
    while fitting > FEWEST_BINS and single + (facts.bytes - single) * fitting > broadcast_limit:
        fitting //= 2
    if single + (facts.bytes - single) * fitting <= broadcast_limit:
        facts.bins = fitting

    used = {c: c if c in crowded and facts.bins > 1 else c.rpartition("|")[0] + "|" for c in (r["_code"] for r in top)}
    cases = " ".join(f"WHEN '{c}' THEN '{path}'" for c, path in used.items())
    rows = rows.withColumn("_path", F.expr(f"CASE _code {cases} ELSE {_short_code(facts.bins > 1)} END")).drop("_code")
    facts.codes = sorted(set(used.values()))
    if rare:
        # The kept paths and at most four short ones per attribute.
        facts.codes = sorted(r["_path"] for r in rows.select("_path").distinct().collect())
    facts.shared = tuple(sorted({facts.codes.index(used[c]) for c in shared}))
    return rows, facts


def _thin(borders: Sequence[float], most: int) -> list[float]:
    """At most ``most`` borders, evenly picked, the outermost two among them."""
    if len(borders) <= most:
        return list(borders)
    return [borders[round(i * (len(borders) - 1) / (most - 1))] for i in range(most)]


@dataclass
class Plan:
    """The clause side of the join and the expressions that go with it."""

    attributes: Mapping[str, str]
    columns: Mapping[str, str]  # of each event column its name inside the join
    facts: Facts
    rest: list[str]
    fits_broadcast: bool
    slots: Slots | None = None
    access: Access | None = None  # None: few enough clauses to be compiled
    clause_side: DataFrame | None = None
    # The clauses' literals, one row each, if a clause has so many keys that it would be repeated too often.
    literal_side: DataFrame | None = None

    def value(self, a: str) -> str:
        """An event attribute in the type that the literals have."""
        return f"CAST({self.columns[a]} AS {SPARK_TYPES[self.attributes[a]].simpleString()})"

    @staticmethod
    def literal(n: str) -> str:
        return f"_c{n}"

    def holds(self) -> str:
        return self.slots.holds(self.value, self.literal)

    def with_bins(self, events: DataFrame) -> DataFrame:
        for columns in self.access.event_bins(self.value):
            events = events.select("*", *(F.expr(x).alias(n) for n, x in columns.items()))
        return events


def _plan(events, columns, subscriptions, attributes, strategy: str, broadcast_limit: int, bins: int) -> Plan | None:
    """None if there is no valid clause at all."""
    rows = durable(_clause_rows(subscriptions, attributes))
    rest = [c for c in rows.columns if c not in ("_tests", "_earlier", "_bytes")]
    facts = _literals(rows, attributes)
    if not facts.used:
        return None
    rows, facts = _paths(rows, facts, bins, broadcast_limit)
    plan = Plan(attributes, columns, facts, rest, True)
    if strategy == "auto" and facts.clauses <= FEW_CLAUSES and facts.bytes <= FEW_BYTES:
        return plan

    plan.slots = Slots(attributes, facts.used, many_one_of=facts.one_of > 1)
    borders = {a: _thin(b, facts.bins + 1) for a, b in facts.borders.items()}
    plan.access = Access(plan.slots, [Path.parse(c, facts.ranked) for c in facts.codes], borders, max(2, facts.bins))
    plan.clause_side, plan.literal_side, facts.keys, facts.key_bytes, facts.literal_bytes = _clause_sides(rows, rest, plan.slots, plan.access, facts, broadcast_limit, many=facts.earlier > 0)
    plan.fits_broadcast = facts.key_bytes + facts.literal_bytes <= broadcast_limit
    return plan


def check_types(schema: T.StructType, attributes: Mapping[str, str]) -> None:
    """Raise unless every declared attribute is a column whose values all have the declared type: an integer may be declared a float."""
    actual = attributes_of(schema)
    for name, kind in attributes.items():
        if name not in actual:
            raise ValueError(f"no event column of an attribute type: {name}")
        if actual[name] != kind and (actual[name], kind) != (INTEGER, FLOAT):
            raise ValueError(f"{name} is declared as {kind}, but the event column is {actual[name]}")


def match(
    events: DataFrame,
    subscriptions: DataFrame,
    attributes: Mapping[str, str] | None = None,
    strategy: str = "auto",
    key: Sequence[str] = ("event_id",),
    broadcast_limit: int = BROADCAST_BYTES,
    bins: int = MAX_BINS,
) -> DataFrame:
    """Every (event, subscription) pair whose predicate holds, each once.

    ``subscriptions`` has ``sub_id``, ``clauses`` (``CLAUSES_TYPE``) and any columns to carry along,
    such as ``topic``; subscriptions that do not fit the attribute schema match nothing. ``key``
    names the columns that tell events apart; it is used only when the clause table is too large
    to broadcast. ``strategy="template"`` is the join described above, ``"compiled"`` evaluates one
    expression per subscription; both give the same result and ``"auto"`` takes the second for a few
    clauses.
    """
    attributes = dict(attributes or attributes_of(events.schema))
    check_types(events.schema, attributes)
    clash = set(events.columns) & (set(subscriptions.columns) - {"clauses", "expression"})
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if "clauses" not in subscriptions.columns:
        if strategy == "template":
            raise ValueError("free texts have no clauses: use the compiled strategy")
        if strategy == "compiled":
            return match_compiled(events, subscriptions, attributes)
        return _match_texts(events, subscriptions, attributes, key, broadcast_limit, bins)
    if strategy == "compiled":
        return match_compiled(events, valid_subscriptions(subscriptions, attributes), attributes)
    if strategy not in ("auto", "template"):
        raise ValueError(f"unknown strategy: {strategy}")

    columns = _names(events)
    carried = [c for c in subscriptions.columns if c not in ("clauses", "expression")]
    renamed = subscriptions.select("clauses", *(_col(c).alias(f"r{i}") for i, c in enumerate(carried)))
    plan = _plan(events, columns, renamed, attributes, strategy, broadcast_limit, bins)
    if plan is None:
        rest = [f for f in subscriptions.schema.fields if f.name not in ("clauses", "expression")]
        return events.where(F.lit(False)).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    if plan.access is None:
        return match_compiled(events, valid_subscriptions(subscriptions, attributes), attributes)

    if plan.fits_broadcast:
        out = _meet(_probing(events, plan), plan)
        return out.select(*(F.col(n).alias(c) for c, n in columns.items()), *(F.col(f"r{i}").alias(c) for i, c in enumerate(carried)))
    return _late(events, plan, [*key], carried, broadcast_limit)


def _match_texts(events: DataFrame, subscriptions: DataFrame, attributes: Mapping[str, str], key: Sequence[str], broadcast_limit: int, bins: int) -> DataFrame:
    """``match`` for (sub_id, expression) rows: by their clauses where they have some, compiled where not; invalid texts match nothing."""
    from fansieve.operators.texts import parse_texts

    read = parse_texts(subscriptions, attributes, events.schema)
    regular = read.where("clauses IS NOT NULL").select(F.col("expression").alias("_text"), "clauses")
    rows = subscriptions.join(regular, F.col("expression") == F.col("_text")).drop("_text", "expression")
    out = match(events, rows, attributes, "auto", key, broadcast_limit, bins)
    irregular = read.where("clauses IS NULL AND reason IS NULL").select(F.col("expression").alias("_text"))
    if not irregular.head(1):
        return out
    return out.unionByName(match_compiled(events, subscriptions.join(irregular, F.col("expression") == F.col("_text"), "left_semi"), attributes))


def match_pairs(
    events: DataFrame,
    subscriptions: DataFrame,
    attributes: Mapping[str, str] | None = None,
    key: Sequence[str] = ("event_id",),
    broadcast_limit: int = BROADCAST_BYTES,
    bins: int = MAX_BINS,
) -> DataFrame:
    """As ``match``, but of the event only ``key`` and the declared attributes: nothing else is read or moved."""
    attributes = dict(attributes or attributes_of(events.schema))
    return match(events.select(*map(_col, dict.fromkeys([*key, *attributes]))), subscriptions, attributes, "auto", key, broadcast_limit, bins)


def _probing(events: DataFrame, plan: Plan, more: Sequence[Column] = ()) -> DataFrame:
    """The events' side of the join: one row per access path, or per element of its list.

    The columns inside have names of their own: e0, e1, ... for the events', r0, r1, ... for what the subscriptions carry, and names that
    start with "_" for what is made here. With ``more`` columns every event has a row that meets nothing.
    """
    probing = plan.with_bins(events.select(*(_col(c).alias(n) for c, n in plan.columns.items() if c in events.columns), *more))
    names = probing.columns
    return (
        probing.select("*", F.expr(f"explode({plan.access.probes(plan.value, bool(more))})").alias("_probe"))
        .select(*map(_col, names), F.expr("_probe.p AS _p"), F.expr("_probe.s AS _s"), F.expr("_probe.n AS _v"))
        .where("_p IS NOT NULL")
        .withColumn("_k", F.expr(plan.access.event_key(plan.value)))
    )


def _conditions(plan: Plan) -> tuple[Column, str]:
    """When probe and key row meet, and what else must hold of event and literals.

    The order matters: the cheap literal checks come first and run on every candidate pair. The path number is part of the key; as a
    difference it stays out of the join key, which is then a single bigint.
    """
    residual = [plan.holds(), *plan.access.first_element_only(plan.value, plan.literal)]
    if plan.facts.earlier:
        residual.append(f"NOT {_held_before(plan.slots, plan.value, plan.facts.earlier)}")
    meets = ["_k = _key", "_c_path - _p = 0", *plan.access.same_value(plan.facts.shared, plan.value), *([_and(residual)] if plan.literal_side is None else [])]
    return F.expr(_and(meets)), _and(residual)


def _meet(probing: DataFrame, plan: Plan, how: str = "inner") -> DataFrame:
    """Probes with the clauses that hold, the clause side in every task; for a side of a counted size."""
    on, residual = _conditions(plan)
    out = probing.join(F.broadcast(plan.clause_side), on, how)
    if plan.literal_side is not None:
        out = out.join(F.broadcast(plan.literal_side), F.expr(f"_key_no = _no AND {residual}"), how)
    return out


# --- a clause table too large to broadcast ------------------------------------------------------


# Events with an access key, per different tested attributes among them, from which on the latter meet the clauses in their stead.
ALIKE = 8


def _late(events: DataFrame, plan: Plan, key: Sequence[str], carried: Sequence[str], broadcast_limit: int) -> DataFrame:
    """A shuffle join of access keys, of which the events' other columns are no part.

    What is shuffled is the key and the attributes that the clauses test, after probes whose access key no clause has are dropped. If the events
    have more columns, each of them that matches meets its subscriptions afterwards, by key and attributes, null or not: events that are
    equal in these match the same, so they are matched once, and keys need not be unique. Where that would shuffle more pairs than
    there are events, the other columns go along instead. Where few attribute values stand for many events, these values alone meet the clauses, and the events are broadcast to what matched.
    """
    used = [a for a in plan.attributes if a in plan.facts.used]
    alike = _few_alike(events, plan, used, broadcast_limit)
    if alike is not None:
        return _by_values(*alike, plan, carried, broadcast_limit)
    narrow = [c for c in plan.columns if c in {*key, *used}]
    more = [c for c in plan.columns if c not in narrow]
    moved = events.select(*map(_col, narrow))
    probing = _known_keys(_probing(moved.distinct() if more else moved, plan), plan)
    sample = _sample(probing)
    if more and _candidates(sample, plan) > events.count():
        narrow, more = [*plan.columns], []
        probing = _known_keys(_probing(events, plan), plan)
    out = _with_literals(_salted_join(probing, plan.clause_side, _conditions(plan)[0], sample), plan, broadcast_limit)
    of_event = {c: plan.columns[c] for c in narrow}
    rest = [F.col(f"r{i}").alias(c) for i, c in enumerate(carried)]
    if not more:
        return out.select(*(F.col(of_event[c]).alias(c) for c in plan.columns), *rest)
    out = out.select(*(F.col(n).alias(f"m{i}") for i, n in enumerate(of_event.values())), *(F.col(f"r{i}") for i in range(len(carried))))
    whole = events.select(*(_col(c).alias(n) for c, n in plan.columns.items()))
    return whole.join(out.hint("shuffle_hash"), _same(of_event.values())).select(*(F.col(n).alias(c) for c, n in plan.columns.items()), *rest)


def _same(names) -> Column:
    """Whether event columns are those that matched, m0, m1, ...: null or not."""
    return reduce(and_, (F.col(n).eqNullSafe(F.col(f"m{i}")) for i, n in enumerate(names)))


def _with_literals(out: DataFrame, plan: Plan, broadcast_limit: int) -> DataFrame:
    """What met by access keys, if the literals are a table of their own."""
    if plan.literal_side is None:
        return out
    side = F.broadcast(plan.literal_side) if plan.facts.literal_bytes <= broadcast_limit else plan.literal_side.hint("merge")
    return out.join(side, F.expr(f"_key_no = _no AND {_conditions(plan)[1]}"))


def _few_alike(events: DataFrame, plan: Plan, used: Sequence[str], broadcast_limit: int) -> tuple[DataFrame, DataFrame] | None:
    """(different tested attributes with an access key, whole events that have them), both numbered ``_alike``, if these are few and the events can be broadcast."""
    if not used:
        return None
    probes = _known_keys(_probing(events.select(*map(_col, used)), plan), plan)
    names = [plan.columns[a] for a in used]
    total = probes.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*names, "_p", "_k")).alias("d")).first()
    if not total["n"] or total["n"] < ALIKE * total["d"]:
        return None
    values = durable(probes.distinct())
    if table_bytes(values) > broadcast_limit // 4:
        return None
    held = values.select(*(F.col(n).alias(f"m{i}") for i, n in enumerate(names))).distinct()
    held = durable(held.withColumn("_alike", F.monotonically_increasing_id()))
    values = values.join(held, _same(names)).drop(*(f"m{i}" for i in range(len(names))))
    whole = events.select(*(_col(c).alias(n) for c, n in plan.columns.items()))
    whole = whole.join(F.broadcast(held), _same(names)).select(*whole.columns, F.col("_alike").alias("_of"))
    # Half of the limit, as the values and literals may be broadcast beside them.
    return (values, whole) if table_bytes(whole) <= broadcast_limit // 2 else None


def _by_values(values: DataFrame, whole: DataFrame, plan: Plan, carried: Sequence[str], broadcast_limit: int) -> DataFrame:
    """Clauses meet attribute values, and what matched, dealt evenly, the events that have them."""
    matched = _with_literals(plan.clause_side.join(F.broadcast(values), _conditions(plan)[0]), plan, broadcast_limit)
    matched = matched.select("_alike", *(F.col(f"r{i}") for i in range(len(carried))))
    matched = matched.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = matched.join(F.broadcast(whole), F.col("_alike") == F.col("_of"))
    return out.select(*(F.col(n).alias(c) for c, n in plan.columns.items()), *(F.col(f"r{i}").alias(c) for i, c in enumerate(carried)))


# Access keys that are broadcast as they are, 16 bytes each; beyond that, their bits in a map of so many.
FILTER_KEYS, FILTER_BITS = 8_000_000, 1 << 28


def _known_keys(probing: DataFrame, plan: Plan) -> DataFrame:
    """The probes whose access key some clause has, or, with very many keys, may have (a Bloom filter of one hash)."""
    keys = plan.clause_side.select(F.col("_key").alias("_known")).distinct()
    if plan.facts.keys <= FILTER_KEYS:
        return probing.join(F.broadcast(keys), F.col("_k") == F.col("_known"), "left_semi")
    bit = F.pmod(F.xxhash64("_known"), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(bit, 6).alias("_word"), (bit % 64).cast("int").alias("_bit"))
    words = durable(words.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")))
    place = f"pmod(xxhash64(_k), {FILTER_BITS}L)"
    return probing.join(F.broadcast(words), F.expr(f"shiftright({place}, 6) = _word AND getbit(_bits, CAST({place} % 64 AS int)) = 1"), "left_semi")


# The share of probes that is looked at for heavy access keys, and the share of these, in parts of an average task, that makes one heavy.
SAMPLED, HEAVY = 0.02, 0.5
# Probes of a heavy key that a task holds at once, about.
HELD = 100_000


def _sample(probing: DataFrame) -> DataFrame:
    """How often each access key is among some of the probes: ``_k``, ``n``."""
    return durable(probing.sample(SAMPLED, seed=1).groupBy("_k").agg(F.count("*").alias("n")))


def _candidates(sample: DataFrame, plan: Plan) -> float:
    """About how many pairs meet on an access key."""
    keys = plan.clause_side.groupBy("_key").agg(F.count("*").alias("c"))
    return (sample.join(keys, F.col("_k") == F.col("_key")).agg(F.sum(F.col("n") * F.col("c").cast("double"))).first()[0] or 0) / SAMPLED


def _salted_join(probing: DataFrame, clause_side: DataFrame, on: Column, sample: DataFrame) -> DataFrame:
    """Shuffle join in which heavy access keys, and only these, are spread over several tasks.

    They are found in ``sample``. A key with a third of all probes gets so many salts that each holds about half of an average task. Its probes are dealt to some
    of them and its clauses to the others, like rows and columns of a grid, by how many there are of each: a probe is repeated for each share of the clauses and a clause for each share
    of the probes, so that neither is repeated for every salt where both are many. There cannot be more heavy keys than tasks, times a constant.
    """
    spark = probing.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sample.agg(F.sum("n")).first()[0] or 0
    least = max(HEAVY * total / partitions, 10)
    heavy = sample.where(F.col("n") >= least).select(F.col("_k").alias("_heavy"), F.ceil(F.col("n") / (HEAVY * total / partitions)).alias("_salts"), (F.col("n") / SAMPLED).alias("_n"))
    clauses = clause_side.groupBy(F.col("_key").alias("_heavy")).agg(F.count(F.lit(1)).alias("_c"))
    heavy = durable(heavy).join(clauses, "_heavy", "left").withColumn("_shares", F.expr(f"CAST(least(_salts, ceil(greatest(sqrt(_salts * _n / coalesce(_c, 1)), _n / {HELD}))) AS int)"))
    heavy = F.broadcast(durable(heavy.select("_heavy", "_shares", F.ceil(F.col("_salts") / F.col("_shares")).cast("int").alias("_cshares"))))

    def dealt(side: DataFrame, key: str, columns: Sequence[str], own: str, other: str) -> DataFrame:
        """The side's rows, those of heavy keys with the number of their ``own`` share and repeated for each ``other`` one: ``_i`` and ``_j``, 0 for the others."""
        side = side.join(heavy, F.col(key) == F.col("_heavy"), "left")
        number = F.coalesce(F.pmod(F.xxhash64(*map(_col, columns)), F.col(own)), F.lit(0)).cast("int")
        return side.withColumns({"_i": number, "_j": F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).drop("_heavy", "_shares", "_cshares")

    left = dealt(probing, "_k", [c for c in probing.columns if c.startswith("e")], "_shares", "_cshares")
    told = [f.name for f in clause_side.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name not in ("_key", "_c_path")] or ["_key"]
    right = dealt(clause_side, "_key", told, "_cshares", "_shares").withColumnsRenamed({"_i": "_ci", "_j": "_cj"})
    # Clause by clause, as the probes of a key are narrower to hold and a clause's pairs then follow each other, which aggregates by subscription like.
    return right.join(left.hint("merge"), on & (F.col("_i") == F.col("_cj")) & (F.col("_j") == F.col("_ci")))


def _names(events: DataFrame) -> dict[str, str]:
    return {c: f"e{i}" for i, c in enumerate(events.columns)}


def _clause_sides(rows, rest, slots: Slots, access: Access, facts: Facts, broadcast_limit: int, many: bool) -> tuple[DataFrame, DataFrame | None, int, int, int]:
    """The clause side of the join: keys and literals of every clause that can hold at all.

    Returns (key rows, literal rows, number of key rows, their bytes, bytes of the literal rows). Clauses with few keys have their literals in
    every key row, and no literal rows; so have all whose literals are short and, with the keys, too large to broadcast. A clause with an ``in`` or a list of a thousand literals has a thousand keys; its key rows are
    narrow, and its literals are stored once. On shared paths the key rows belong to a list, and to all clauses that have it: these have its
    number and not the list itself, as the key rows hold its literals. Sizes are counted, not estimated from the clause alone.
    """
    codes = facts.codes
    literals = slots.build("_tests")
    numbers = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(codes))
    wide = rows.select(
        *map(_col, rest),
        *(F.expr(x).alias(n) for n, x in literals.items()),
        F.expr(f"CASE _path {numbers} END").alias("_path"),
        *([F.col("_earlier")] if many else []),
        "_bytes",
    )
    wide = wide.where("_possible")
    if many:
        fields = ", ".join(f"'{n}', {x}" for n, x in slots.build("_s").items())
        wide = wide.withColumn("_earlier", F.expr(f"filter(transform(_earlier, _s -> named_struct({fields})), _e -> _e._possible)"))
    for columns in access.clause_bins():
        wide = wide.select("*", *(F.expr(x).alias(n) for n, x in columns.items()))
    keys = " ".join(f"WHEN {i} THEN {access.clause_keys(i)}" for i in range(len(codes)) if i not in facts.shared)
    lists = {i: f"{slots.names[access.paths[i].member]}_in" for i in facts.shared}
    literal = {n: F.col(n) for n in literals if n != "_possible"}
    for n in set(lists.values()):
        literal[n] = F.expr(f"CASE WHEN _path NOT IN ({', '.join(str(i) for i in lists if lists[i] == n)}) THEN {n} END")
    named = " ".join(f"WHEN {i} THEN sha2(to_json(named_struct('p', _path, 'v', {n})), 256)" for i, n in lists.items())
    wide = wide.select(
        *map(_col, rest),
        *(x.alias(f"_c{n}") for n, x in literal.items()),
        *([F.col("_earlier").alias("_c_earlier")] if many else []),
        "_bytes",
        F.expr(f"CASE _path {keys} END" if keys else "CAST(NULL AS array<struct<p:int,k:bigint>>)").alias("_entries"),
        *([F.expr(f"CASE _path {named} END").alias("_list")] if lists else []),
        *(F.expr(f"CASE WHEN _path = {i} THEN {n} END").alias(f"_list{i}") for i, n in lists.items()),
    )
    body = wide.columns[: wide.columns.index("_bytes")]
    if lists:
        wide = wide.withColumn("_bytes", F.when(F.col("_list").isNull(), F.col("_bytes")).otherwise(row_bytes(wide.select(*map(_col, body)))))
    # Stored, as the sizes decide the plan and the expressions above are too long to run twice; counted while it is written.
    n_keys, sizes = F.coalesce(F.array_size("_entries"), F.lit(0)).cast("long"), Observation()
    made = row_bytes(wide.select(*map(_col, body)))
    counted = (F.count(F.lit(1)).alias("clauses"), F.sum(n_keys).alias("keys"), F.sum("_bytes").alias("once"), F.sum(F.col("_bytes") * n_keys).alias("each"))
    counted += (F.sum(made).alias("made_once"), F.sum(made * n_keys).alias("made_each"))
    wide = durable(wide.withColumn("_no", F.monotonically_increasing_id()).observe(sizes, *counted))
    clauses, n_keys, once, each = (sizes.get[c] or 0 for c in ("clauses", "keys", "once", "each"))
    entry = [F.expr("_entry.p AS _c_path"), F.expr("_entry.k AS _key")]
    narrow = wide.select("_no", F.explode("_entries").alias("_entry")).select(F.col("_no").alias("_key_no"), *entry)
    if lists:
        first = durable(wide.where("_list IS NOT NULL").groupBy(F.col("_list").alias("_same")).agg(F.min("_no").alias("_first")))
        held = wide.join(first.select("_first"), F.col("_no") == F.col("_first"), "left_semi")
        entries = " ".join(f"WHEN _list{i} IS NOT NULL THEN {access.shared_keys(i, f'_list{i}')}" for i in lists)
        held = held.select("_no", F.expr(f"explode(CASE {entries} END)").alias("_entry")).select(F.col("_no").alias("_key_no"), *entry, F.expr("_entry.s AS _key_s"), F.expr("_entry.n AS _key_n"))
        sizes = Observation()
        texts = F.coalesce(F.octet_length("_key_s"), F.lit(0))
        held = durable(held.observe(sizes, F.count(F.lit(1)).alias("keys"), F.sum(texts.cast("long")).alias("texts")))
        narrow = narrow.unionByName(held, allowMissingColumns=True)
        n_keys += sizes.get["keys"] or 0
        literal_rows = wide.join(first, F.col("_list") == F.col("_same"), "left").select(*map(_col, body), F.coalesce("_first", "_no").alias("_no"))
        return narrow, literal_rows, n_keys, KEY_BYTES * n_keys + (sizes.get["texts"] or 0), once
    made_once, made_each = (sizes.get[c] or 0 for c in ("made_once", "made_each"))
    shuffled = once + KEY_BYTES * n_keys > broadcast_limit and made_each <= MOST_COPIES * (made_once + KEY_BYTES * n_keys)
    if n_keys <= MANY_KEYS * clauses or each <= once + KEY_BYTES * n_keys or shuffled:
        return wide.select(*map(_col, body), F.explode("_entries").alias("_entry")).select(*map(_col, body), *entry), None, n_keys, each + KEY_BYTES * n_keys, 0
    return narrow, wide.drop("_entries", "_bytes"), n_keys, KEY_BYTES * n_keys, once


def _held_before(slots: Slots, event, most: int) -> str:
    """Whether an earlier clause of the subscription holds too, so that it emits the pair."""
    if most > MAX_UNROLLED:
        return f"exists(_c_earlier, _row -> coalesce({slots.holds(event, lambda n: f'_row.{n}')}, false))"
    checks = [
        f"(size(_c_earlier) > {i} AND coalesce({slots.holds(event, lambda n, i=i: f'get(_c_earlier, {i}).{n}')}, false))"
        for i in range(most)
    ]
    return "(" + " OR ".join(checks) + ")"


# --- shapes of the result -----------------------------------------------------------------------


def match_ids(
    events: DataFrame,
    subscriptions: DataFrame,
    key: str = "event_id",
    decodable: str | None = None,
    attributes: Mapping[str, str] | None = None,
    strategy: str = "auto",
    broadcast_limit: int = BROADCAST_BYTES,
    bins: int = MAX_BINS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, ids), a row per event: the sorted ids it matches; empty for none, NULL for undecodable events.

    ``decodable`` names a boolean column that is false for events that could not be decoded; ``carry`` names columns to keep. While the clause
    side is broadcast, no event leaves its task: its rows lie next to each other after the join and become one again there.
    """
    attributes = dict(attributes or attributes_of(events.schema))
    check_types(events.schema, attributes)
    kept = list(dict.fromkeys([key, *carry]))
    ok = F.coalesce(_col(decodable), F.lit(False)) if decodable else F.lit(True)
    kind = T.ArrayType(subscriptions.schema["sub_id"].dataType)
    columns = {c: f"e{i}" for i, c in enumerate(dict.fromkeys([*kept, *attributes]))}
    if "clauses" not in subscriptions.columns or strategy == "compiled":
        valid = subscriptions if "clauses" not in subscriptions.columns else valid_subscriptions(subscriptions, attributes)
        return events.select(*map(_col, kept), F.when(ok, ids_compiled(valid, attributes, events.schema)).cast(kind).alias("ids"))
    plan = _plan(events, columns, subscriptions.select("clauses", F.col("sub_id").alias("r0")), attributes, strategy, broadcast_limit, bins)
    if plan is None:
        return events.select(*map(_col, kept), F.when(ok, F.array()).cast(kind).alias("ids"))
    if plan.access is None:
        return events.select(*map(_col, kept), F.when(ok, ids_compiled(valid_subscriptions(subscriptions, attributes), attributes, events.schema)).cast(kind).alias("ids"))
    if not plan.fits_broadcast:
        return _ids_grouped(events, plan, kept, ok, kind, broadcast_limit)
    rows = _probing(events, plan, [F.monotonically_increasing_id().alias("_row"), ok.alias("e_ok")])
    met = _meet(rows, plan, "left").where("_p = -1 OR (e_ok AND r0 IS NOT NULL)")
    names = [columns[c] for c in kept]
    met = met.select("_row", *names, "e_ok", F.col("r0").alias("sub_id"))
    out = met.mapInArrow(_one_row_per_event(["e_ok", *names]), T.StructType([met.schema["e_ok"], *(met.schema[n] for n in names), T.StructField("ids", kind)]))
    return out.select(*(F.col(columns[c]).alias(c) for c in kept), F.when(F.col("e_ok"), F.col("ids")).alias("ids"))


def _one_row_per_event(names: Sequence[str]):
    """A task that puts the rows of each event, which follow each other, together: ``names`` and the sorted ids."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        def done(held: pa.Table, first: np.ndarray) -> pa.RecordBatch:
            """The events that begin at ``first``, the last of which goes on to the end."""
            sub = held.column("sub_id").combine_chunks()
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, held.num_rows)))
            there = np.flatnonzero(sub.is_valid().to_numpy(zero_copy_only=False))
            pairs = pa.table({"number": number[there], "sub_id": sub.take(pa.array(there))}).sort_by([("number", "ascending"), ("sub_id", "ascending")])
            offsets = np.searchsorted(pairs.column("number").to_numpy(), np.arange(len(first) + 1)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pairs.column("sub_id").combine_chunks())
            of_event = held.select(list(names)).take(pa.array(first)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(of_event.column(n).combine_chunks() for n in names), ids], names=[*names, "ids"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            row = held.column("_row").to_numpy()
            if (np.diff(row) < 0).any():
                raise RuntimeError("the rows of an event do not follow each other")
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else np.zeros(0, np.int64)
            if len(first) > 1:
                # The last event may go on in the next batch.
                yield done(held.slice(0, first[-1]), first[:-1])
                held = held.slice(first[-1])
        if held is not None and held.num_rows:
            yield done(held, np.zeros(1, np.int64))

    return task


def _ids_grouped(events: DataFrame, plan: Plan, kept: Sequence[str], ok: Column, kind: T.ArrayType, broadcast_limit: int) -> DataFrame:
    """``match_ids`` above the broadcast limit: pairs meet the events by key and attributes."""
    names = plan.columns
    key = [c for c in names if c in kept or c in plan.facts.used]
    moved = events.where(ok).select(*map(_col, key)).distinct()
    narrow = Plan(plan.attributes, {c: names[c] for c in key}, plan.facts, plan.rest, False, plan.slots, plan.access, plan.clause_side, plan.literal_side)
    pairs = _late(moved, narrow, key, ["sub_id"], broadcast_limit)
    lists = pairs.groupBy(*map(_col, key)).agg(F.sort_array(F.collect_list("sub_id")).alias("ids"))
    lists = lists.select(*(_col(c).alias(f"m{i}") for i, c in enumerate(key)), "ids")
    rows = events.select(*(_col(c).alias(names[c]) for c in key), ok.alias("_ok"))
    same = reduce(and_, (F.col(names[c]).eqNullSafe(F.col(f"m{i}")) for i, c in enumerate(key)))
    ids = F.when(F.col("_ok"), F.coalesce("ids", F.array().cast(kind)))
    return rows.join(lists.hint("shuffle_hash"), same, "left").select(*(F.col(names[c]).alias(c) for c in kept), ids.alias("ids"))


def with_topic(subscriptions: DataFrame, output_prefix: str) -> DataFrame:
    """Add the output topic ``<prefix>.<sub_id>``."""
    if not output_prefix:
        raise ValueError("output prefix is empty")
    return subscriptions.withColumn("topic", F.concat_ws(".", F.lit(output_prefix), F.col("sub_id").cast("string")))


def fan_out(events: DataFrame, subscriptions: DataFrame, output_prefix: str, **options) -> DataFrame:
    """One row per event and matching subscription, with the topic it goes to."""
    return match(events, with_topic(subscriptions, output_prefix), **options)


def active_only(subscriptions: DataFrame, active: DataFrame) -> DataFrame:
    """Leave out subscriptions that are no longer active, before the join rather than after it."""
    return subscriptions.join(active.select("sub_id").distinct(), "sub_id", "left_semi")


def unmatched(
    events: DataFrame,
    subscriptions: DataFrame,
    attributes: Mapping[str, str] | None = None,
    key: str = "event_id",
    broadcast_limit: int = BROADCAST_BYTES,
    bins: int = MAX_BINS,
) -> DataFrame:
    """Events that no subscription matches.

    With a broadcast clause table and a few access paths the events pass one anti join per path and
    are not shuffled. List attributes have several keys per event, so these look up the matched
    attribute values instead. ``key`` is kept for callers; events are never told apart by it.
    """
    attributes = dict(attributes or attributes_of(events.schema))
    check_types(events.schema, attributes)
    columns = _names(events)
    if "clauses" not in subscriptions.columns:
        return events.where(~any_holds(subscriptions, attributes, events.schema))
    plan = _plan(events, columns, subscriptions.select("clauses", "sub_id"), attributes, "auto", broadcast_limit, bins)
    if plan is None:
        return events
    if plan.access is None:
        return events.where(~any_holds(valid_subscriptions(subscriptions, attributes), attributes, events.schema))
    lists = any(path.element for path in plan.access.paths)
    keys = [] if lists else plan.access.plain_keys(plan.value)
    if not plan.fits_broadcast or plan.literal_side is not None or lists or len(keys) > MAX_ANTI_JOINS:
        # Whether an event matches depends on its attributes alone, so no key is needed, which might be NULL or repeated.
        used = [a for a in attributes if a in plan.facts.used]
        matched = match(events.select(*map(_col, used)), subscriptions.select("sub_id", "clauses"), attributes={a: attributes[a] for a in used}, key=used, broadcast_limit=broadcast_limit, bins=bins)
        matched = matched.select(*(_col(a).alias(f"m{i}") for i, a in enumerate(used))).distinct()
        left = events.select(*(_col(c).alias(n) for c, n in columns.items()))
        same = reduce(and_, (F.col(columns[a]).eqNullSafe(F.col(f"m{i}")) for i, a in enumerate(used)))
        left = left.join(matched, same, "left_anti")
        return left.select(*(F.col(n).alias(c) for c, n in columns.items()))
    left = plan.with_bins(events.select(*(_col(c).alias(n) for c, n in columns.items())))
    for number, expression in keys:
        clauses = plan.clause_side.where(F.col("_c_path") == number)
        on = F.expr(f"_k = _key AND {plan.holds()}")
        left = left.withColumn("_k", F.expr(expression)).join(F.broadcast(clauses), on, "left_anti").drop("_k")
    return left.select(*(F.col(n).alias(c) for c, n in columns.items()))

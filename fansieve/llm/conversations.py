"""Conversation structure repair: a generalised LR parser over the grammar of roles that may also delete, rerole and insert.

A whole conversation is empty, or an optional system row and then pairs of a user's and an assistant's row. The LR states come from the grammar below.
All parses of a conversation go on together in a graph-structured stack: nodes share what is below them, and of stacks with equal tops the one
with the least (cost, audit) stays. That is exact here: what can follow depends on the top alone, and of two equally dear audits over the same
rows none is a prefix of the other (they would differ in inserts, which cost), so their order stays whatever is appended.

Edits, each a letter of the audit: Keep; Rerole to user or assistant; Delete, the only choice for blank rows and duplicates; Insert an empty row. Inserts
come before the row that they stand in front of, so at the end of any run of rows the same holds for audits of that run.

Most conversations are parsed whole, in tasks that read them sorted. Those with more than ``LONG_ROWS`` rows or ``LONG_BYTES`` of text are cut:

1. Their rows are range-partitioned by (conversation, turn) and cut into segments; duplicates within a segment are found there, others by a join of
   each segment's distinct rows.
2. Each segment is parsed from every possible top to every top: a table of costs, and of ranks of the audits (their order is all that matters).
3. Tables of one range partition are put together, then those of one conversation: one table per partition. The cheapest way is chosen there and handed
   down, and each segment parses again along it for its edits and texts.
4. SHA-256 can only be taken in order: the texts of one conversation stream through one task, a batch at a time.

Cases: rows go by turn, null first; of equal turns by the first characters of role and text, then by a digest of both, so repeated rows stand together.
A null role or text counts as one space (a null text is blank). A null ``conv_id`` is a conversation of its own. Empty and white texts are blank. A role
outside the grammar, also the empty one, can be reroled or deleted. A conversation without rows has zeros, no edits and the hash of the empty string; an
empty table gives an empty result. ``gaps`` is null if it exceeds a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.llm.arrow import rows
from fansieve.llm.graph import few
from fansieve.session import durable, table

#: Productions; C is the whole conversation, capitals are not roles' initials.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
NAMES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: Faults of a row.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Conversations beyond one of these are cut into segments that stay within both (or hold one row).
LONG_ROWS, LONG_BYTES = 4096, 16 << 20

_SOLID = re.compile(r"[^\x20\x09-\x0D]")


def _automaton():
    """The LR(0) states as item sets, ``step[state][symbol]``, the reduction of each state, and the states that may be the end."""

    def closure(items: frozenset) -> frozenset:
        while True:
            heads = {GRAMMAR[p][1][dot] for p, dot in items if dot < len(GRAMMAR[p][1])}
            more = items | {(p, 0) for p, (head, _) in enumerate(GRAMMAR) if head in heads}
            if more == items:
                return items
            items = more

    states, step = [closure(frozenset((p, 0) for p, (head, _) in enumerate(GRAMMAR) if head == "C"))], []
    for state in states:
        moves = {}
        for symbol in "suaP":
            onward = closure(frozenset((p, dot + 1) for p, dot in state if GRAMMAR[p][1][dot : dot + 1] == symbol))
            if onward:
                if onward not in states:
                    states.append(onward)
                moves[symbol] = states.index(onward)
        step.append(moves)
    whole = [{p for p, dot in state if dot == len(GRAMMAR[p][1])} for state in states]
    reduce = [next((GRAMMAR[p] for p in done if GRAMMAR[p][0] != "C"), None) for done in whole]
    return step, reduce, {k for k, done in enumerate(whole) if any(GRAMMAR[p][0] == "C" for p in done)}


_STEP, _REDUCE, _END = _automaton()


class Node:
    """A stack's top: its LR state, the node below, and the cheapest edits that lead here."""

    __slots__ = ("state", "below", "cost", "audit")

    def __init__(self, state: int, below: Node | None, cost: int = 0, audit: str = ""):
        self.state, self.below, self.cost, self.audit = state, below, cost, audit


def _shift(node: Node, symbol: str, cost: int, letter: str) -> Node | None:
    """The top after shifting ``symbol`` and all reductions that follow."""
    to = _STEP[node.state].get(symbol)
    if to is None:
        return None
    cost, audit = node.cost + cost, node.audit + letter
    node = Node(to, node)
    while _REDUCE[node.state]:
        head, body = _REDUCE[node.state]
        for _ in body:
            node = node.below
        node = Node(_STEP[node.state][head], node)
    return Node(node.state, node.below, cost, audit)


def _add(tops: dict[int, Node], node: Node | None) -> bool:
    held = node and tops.get(node.state)
    if node is None or held and (held.cost, held.audit) <= (node.cost, node.audit):
        return False
    tops[node.state] = node
    return True


def _with_inserts(tops: dict[int, Node]) -> dict[int, Node]:
    tops, new = dict(tops), list(tops.values())
    while new:
        made = [_shift(node, symbol, INSERT, "I") for node in new for symbol in NAMES]
        new = [node for node in made if _add(tops, node)]
    return tops


def _over(tops: dict[int, Node], initial: str, fault: int) -> dict[int, Node]:
    """The tops after one more row."""
    after: dict[int, Node] = {}
    more = CUT_OFF if fault == TRUNCATED else 0
    for node in _with_inserts(tops).values():
        _add(after, Node(node.state, node.below, node.cost + DELETE, node.audit + "D"))
        if fault in (NONE, TRUNCATED):
            _add(after, _shift(node, initial, more, "K"))
            for symbol in NAMES:
                _add(after, _shift(node, symbol, REROLE + more, "R"))
    return after


def parse(top: Node, initials: str, faults: Iterable[int]) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits of these rows from ``top`` to each top, without inserts after the last row."""
    tops, settled = {top.state: Node(top.state, top.below)}, []
    for k, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        tops = _over(tops, initial, fault)
        if k % 64 == 63:
            # What all audits begin with is settled: a long conversation does not carry it along.
            audits = [node.audit for node in tops.values()]
            same = next((i for i, letters in enumerate(zip(*audits, strict=False)) if len(set(letters)) > 1), min(map(len, audits)))
            settled.append(audits[0][:same])
            for node in tops.values():
                node.audit = node.audit[same:]
    begin = "".join(settled)
    return {state: (node.cost, begin + node.audit) for state, node in tops.items()}


def _states(node: Node | None) -> tuple[int, ...]:
    return () if node is None else (*_states(node.below), node.state)


def _reachable() -> tuple[dict[int, Node], dict[int, int]]:
    """A stack for each top that can stand between rows, and how many inserts it is from the end of a conversation."""
    start = Node(0, None)
    tops, known, new = {0: start}, {(0,)}, [start]
    while new:
        node = new.pop()
        for symbol in "sua":
            onward = _shift(node, symbol, 0, "")
            if onward and (there := _states(onward)) not in known:
                known.add(there)
                tops.setdefault(onward.state, onward)
                new.append(onward)
    ends = {}
    for state, node in tops.items():
        ends[state] = min(len(n.audit) for n in _with_inserts({state: Node(state, node.below)}).values() if n.state in _END)
    return tops, ends


_TOPS, _INSERTS_TO_END = _reachable()
_STATES = sorted(_TOPS)


def finish(ways: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest of these ways to the end of a conversation, inserts after the last row included."""
    return min((cost + INSERT * _INSERTS_TO_END[state], audit + "I" * _INSERTS_TO_END[state]) for state, (cost, audit) in ways.items())


def apply(state: int, audit: str, initials: str) -> Iterator[tuple[int | None, str, str | None]]:
    """What an audit does from a top on: (row or none, letter, the role's name it gives or none for the row's own)."""
    top, row = Node(state, _TOPS[state].below), 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        # Besides a system row that is kept, only one role can come next.
        symbol = initials[row] if letter == "K" else next(s for s in NAMES if s in _STEP[top.state])
        top = _shift(top, symbol, 0, "")
        yield (None if letter == "I" else row), letter, (None if letter == "K" else NAMES[symbol])
        row += letter != "I"


def initial(role: str) -> str:
    """A role's first character if it is in the grammar."""
    return role[0] if role[:1] in ("s", "u", "a") and role else "-"


def own_fault(text: str) -> int:
    """The fault that a text has by itself."""
    solid = next((c for c in reversed(text) if _SOLID.match(c)), None)
    return BLANK if solid is None else NONE if solid in ".!?" else TRUNCATED


def _illegal(pairs: Iterable[tuple[str, str]]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairs)


def _gaps(turns: list[int]) -> int | None:
    n = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return n if n < 1 << 63 else None


#: Nulls come first.
_ORDER = ("conv_id", "turn", "tie")


def _with_tie(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` without nulls in the last two, ``tie`` that orders equal turns, ``gone`` if there is none such column."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    there = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), *([] if "gone" not in conversations.columns else ["gone"]))
    there = there if "gone" in there.columns else there.withColumn("gone", F.lit(False))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return there.withColumn("tie", F.concat(F.substring("role", 1, 16), F.lit(":"), F.substring("text", 1, 48), F.lit(":"), digest))


def _whole(table_rows: DataFrame, turns: bool) -> DataFrame:
    """Repair conversations that fit into a task's memory."""
    kind = table_rows.schema["conv_id"].dataType.simpleString()

    def repair(conv, held: list[tuple]) -> tuple[tuple, list[tuple]]:
        roles, texts = [r for _, r, _ in held], [t for _, _, t in held]
        faults, seen = [], set()
        for role, text in zip(roles, texts, strict=True):
            fault = own_fault(text)
            faults.append(DUPLICATE if fault != BLANK and (role, text) in seen else fault)
            seen.add((role, text))
        initials = "".join(map(initial, roles))
        cost, audit = finish(parse(_TOPS[0], initials, faults))
        made = [(letter, name or roles[k], "" if k is None else texts[k]) for k, letter, name in apply(0, audit, initials)]
        counts = [sum(f == kind for f in faults) for kind in (BLANK, DUPLICATE, TRUNCATED)]
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in made).encode()).hexdigest()
        gaps = _gaps([t for t, _, _ in held if t is not None])
        return (conv, gaps, *counts, _illegal(zip(roles, roles[1:], strict=False)), cost, audit, digest), made

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, begun, schema = None, [], False, None

        def batch(done: list) -> pa.RecordBatch:
            if not turns:
                return rows(schema, **dict(zip(schema.names, zip(*[row for row, _ in done], strict=True), strict=True)))
            flat = [(row[0], 0, k, *turn) for row, made in done for k, turn in enumerate(made)]
            return rows(schema, **dict(zip(schema.names, zip(*flat, strict=True) if flat else [[]] * len(schema), strict=True)))

        for some in batches:
            id_type = some.column("conv_id").type
            schema = schema or pa.schema([("conv_id", id_type), *(_TURNS if turns else _DIGESTS)])
            done = []
            for conv, turn, role, text, gone in zip(*(some.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if begun and conv != now:
                    done.append(repair(now, held))
                    held = []
                now, begun = conv, True
                if not gone:
                    held.append((turn, role, text))
            if done:
                yield batch(done)
        if begun:
            yield batch([repair(now, held)])

    ordered = table_rows.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "turn", "role", "text", "gone")
    return ordered.mapInArrow(task, f"conv_id {kind}, {_TURNS_SQL if turns else _DIGESTS_SQL}")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_DIGESTS = [*[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
_DIGESTS_SQL = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_TURNS = [("part", pa.int64()), ("place", pa.int32()), ("action", pa.string()), ("role", pa.string()), ("text", pa.string())]
_TURNS_SQL = "part long, place int, action string, role string, text string"
_SUMMARY_SQL = "costs array<int>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, first string, last string"
_NO_WAY = -1


def _cut(large: DataFrame, long_rows: int, long_bytes: int) -> DataFrame:
    """The rows in order, as ``(conv_id, part, place, ...)``: ``part`` is the range partition (upper half) and the segment."""
    kind = large.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, size, before = (TaskContext.get().partitionId() << 32) - 1, 0, 0, object()
        for some in batches:
            parts, places = [], []
            for conv, role, text in zip(*(some.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                n = len(role) + len(text)
                if conv != before or place >= long_rows or size + n > long_bytes:
                    part, place, size, before = part + 1, 0, 0, conv
                parts.append(part)
                places.append(place)
                place, size = place + 1, size + n
            names = ["conv_id", "part", "place", "turn", "role", "text", "digest"]
            yield pa.RecordBatch.from_arrays(
                [some.column("conv_id"), pa.array(parts, pa.int64()), pa.array(places, pa.int32()), *[some.column(c) for c in names[3:]]], names=names
            )

    # Rows that are alike in all else may be dealt anyhow.
    large = durable(large.withColumn("salt", F.monotonically_increasing_id()).withColumn("digest", F.substring("tie", -64, 64)))
    ordered = large.repartitionByRange(*_ORDER, F.xxhash64("salt")).sortWithinPartitions(*_ORDER)
    ordered = ordered.select("conv_id", "turn", "role", "text", "digest")
    return durable(ordered.mapInArrow(task, f"conv_id {kind}, part long, place int, turn long, role string, text string, digest string"))


def _seen_before(ordered: DataFrame) -> DataFrame:
    """``(part, digests)``: what segments share with an earlier segment of the same conversation."""
    seen = durable(ordered.select("conv_id", "digest", "part").distinct())
    first = seen.groupBy("conv_id", "digest").agg(F.min("part").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    first = first.withColumnsRenamed({"conv_id": "its_conv", "digest": "its_digest"})
    again = seen.join(first, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("digest") == F.col("its_digest"))).where(F.col("part") > F.col("first"))
    return again.groupBy("part").agg(F.collect_list("digest").alias("digests"))


def _flat(tables: list[list[tuple | None]]) -> dict:
    """36 ways, each (cost, order) or none, as lists of costs and of ranks by the order."""
    ways = [w for row in tables for w in row]
    rank = {o: k for k, o in enumerate(sorted({w[1] for w in ways if w}))}
    return {"costs": [w[0] if w else _NO_WAY for w in ways], "ranks": [rank[w[1]] if w else 0 for w in ways]}


def _square(row: dict) -> list[list[tuple | None]]:
    ways = [None if c == _NO_WAY else (c, r) for c, r in zip(row["costs"], row["ranks"], strict=True)]
    n = len(_STATES)
    return [ways[k : k + n] for k in range(0, n * n, n)]


def _together(summaries: list[dict]) -> tuple[dict, list]:
    """One summary of consecutive ones, and for each of them the cheapest predecessor: ``back[k][begin][end]``."""
    n = len(_STATES)
    ways, back = _square(summaries[0]), []
    for s in summaries[1:]:
        onward = _square(s)
        now, came = [[None] * n for _ in range(n)], [[None] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                found = [((w[0] + o[0], (w[1], o[1])), m) for m in range(n) if (w := ways[i][m]) and (o := onward[m][j])]
                if found:
                    now[i][j], came[i][j] = min(found)
        ways = _square(_flat(now))
        back.append(came)
    out = _flat(ways) | {c: sum(s[c] for s in summaries) for c in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += _illegal((a["last"], b["first"]) for a, b in zip(summaries, summaries[1:], strict=False))
    return out | {"first": summaries[0]["first"], "last": summaries[-1]["last"]}, back


def _way(back: list, begin: int, end: int) -> list[tuple[int, int]]:
    """(begin, end) of each of the summaries that were put together."""
    ends = [end]
    for came in reversed(back):
        ends.append(came[begin][ends[-1]])
    ends.reverse()
    return list(zip([begin, *ends], ends, strict=False))


def _cut_and_joined(large: DataFrame, turns: bool, long_rows: int, long_bytes: int) -> DataFrame:
    """Repair conversations in segments; ``turns`` as for ``_whole``."""
    id_sql = large.schema["conv_id"].dataType.simpleString()
    ordered = _cut(large, long_rows, long_bytes)

    def segment(held: pa.Table, before: pa.Table) -> pa.Table:
        held = held.sort_by("place")
        seen = set(before.column("digests")[0].as_py()) if before.num_rows else set()
        roles, faults = held.column("role").to_pylist(), []
        for text, digest in zip(held.column("text").to_pylist(), held.column("digest").to_pylist(), strict=True):
            fault = own_fault(text)
            faults.append(DUPLICATE if fault != BLANK and digest in seen else fault)
            seen.add(digest)
        initials = "".join(map(initial, roles))
        found = [parse(_TOPS[s], initials, faults) for s in _STATES]
        out = {"conv_id": held.column("conv_id")[0].as_py(), "part": held.column("part")[0].as_py()} | _flat([[w.get(s) for s in _STATES] for w in found])
        out |= {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
        out |= {"illegal": _illegal(zip(roles, roles[1:], strict=False)), "first": roles[0][:1], "last": roles[-1][:1], "initials": initials, "faults": bytes(faults)}
        return _table([out], held.schema.field("conv_id").type, "part", ("initials", pa.string()), ("faults", pa.binary()))

    seen = _seen_before(ordered)
    segments = ordered.groupBy("part").cogroup(seen.groupBy("part"))
    segments = durable(segments.applyInArrow(segment, f"conv_id {id_sql}, part long, {_SUMMARY_SQL}, initials string, faults binary"))

    def partition(held: pa.Table) -> pa.Table:
        held = held.sort_by("part")
        out, _ = _together(held.to_pylist())
        return _table([out | {"conv_id": held.column("conv_id")[0].as_py(), "slot": held.column("slot")[0].as_py()}], held.schema.field("conv_id").type, "slot")

    def conversation(held: pa.Table) -> pa.Table:
        held = held.sort_by("slot")
        out, back = _together(held.to_pylist())
        start = _STATES.index(0)
        ways = [(w[0] + INSERT * _INSERTS_TO_END[_STATES[j]], w[1], j) for j, w in enumerate(_square(out)[start]) if w]
        cost, _, end = min(ways)
        conv, n = held.column("conv_id")[0].as_py(), held.num_rows
        columns = {"conv_id": [conv] * n, "slot": held.column("slot"), "begin": [], "end": []}
        for b, e in _way(back, start, end):
            columns["begin"].append(b)
            columns["end"].append(e)
        columns |= {c: [out[c]] * n for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": [cost] * n, "last": [k == n - 1 for k in range(n)]}
        schema = pa.schema([("conv_id", held.schema.field("conv_id").type), *[(c, pa.int64()) for c in list(columns)[1:-1]], ("last", pa.bool_())])
        return pa.table(columns, schema=schema)

    longs = "blank long, duplicate long, truncated long, illegal long"
    summaries = segments.withColumn("slot", F.shiftright("part", 32)).drop("initials", "faults")
    partitions = durable(summaries.groupBy("conv_id", "slot").applyInArrow(partition, f"conv_id {id_sql}, slot long, {_SUMMARY_SQL}"))
    chosen = partitions.groupBy("conv_id").applyInArrow(conversation, f"conv_id {id_sql}, slot long, begin long, end long, {longs}, cost long, last boolean")
    chosen = durable(chosen)

    def hand_down(held: pa.Table, way: pa.Table) -> pa.Table:
        held = held.sort_by("part")
        _, back = _together(held.to_pylist())
        begin, end, last = (way.column(c)[0].as_py() for c in ("begin", "end", "last"))
        steps = _way(back, begin, end)
        ends = [last and k == len(steps) - 1 for k in range(len(steps))]
        return pa.table({"part": held.column("part"), "begin": [b for b, _ in steps], "end": [e for _, e in steps], "last": ends})

    way = chosen.select("conv_id", "slot", "begin", "end", "last")
    steps = summaries.groupBy("conv_id", "slot").cogroup(way.groupBy("conv_id", "slot")).applyInArrow(hand_down, "part long, begin long, end long, last boolean")
    steps = durable(steps.join(segments.select("part", "initials", "faults"), "part"))

    def edit(held: pa.Table, step: pa.Table) -> pa.Table:
        held, step = held.sort_by("place"), step.to_pylist()[0]
        begin, end = _STATES[step["begin"]], _STATES[step["end"]]
        audit = parse(_TOPS[begin], step["initials"], step["faults"])[end][1] + ("I" * _INSERTS_TO_END[end] if step["last"] else "")
        roles, texts = held.column("role").to_pylist(), held.column("text").to_pylist()
        made = [(letter, name or roles[k], "" if k is None else texts[k]) for k, letter, name in apply(begin, audit, step["initials"])]
        conv, part = held.column("conv_id")[0].as_py(), held.column("part")[0].as_py()
        id_type = held.schema.field("conv_id").type
        if turns:
            schema = pa.schema([("conv_id", id_type), *_TURNS])
            return pa.Table.from_pylist([dict(zip(schema.names, (conv, part, k, *turn), strict=True)) for k, turn in enumerate(made)], schema)
        text = "\n".join(f"{role}:{text}" for _, role, text in made)
        schema = pa.schema([("conv_id", id_type), ("part", pa.int64()), ("audit", pa.string()), ("made", pa.int64()), ("text", pa.string())])
        return pa.Table.from_pylist([{"conv_id": conv, "part": part, "audit": audit, "made": len(made), "text": text}], schema)

    kind = f"conv_id {id_sql}, " + (_TURNS_SQL if turns else "part long, audit string, made long, text string")
    edited = ordered.groupBy("part").cogroup(steps.groupBy("part")).applyInArrow(edit, kind)
    if turns:
        return edited

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, audits, sha, any_row, done, id_type = None, False, [], None, False, [], None

        def batch() -> pa.RecordBatch:
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((id_type, pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "audit", "repaired_sha256"])

        for some in batches:
            id_type = some.column("conv_id").type
            for row in some.to_pylist():
                if not begun or row["conv_id"] != now:
                    if begun:
                        done.append((now, "".join(audits), sha.hexdigest()))
                    now, begun, audits, sha, any_row = row["conv_id"], True, [], hashlib.sha256(), False
                audits.append(row["audit"])
                if row["made"]:
                    sha.update(("\n" if any_row else "").encode() + row["text"].encode())
                    any_row = True
        if begun:
            done.append((now, "".join(audits), sha.hexdigest()))
            yield batch()

    texts = durable(edited).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, f"conv_id {id_sql}, audit string, repaired_sha256 string")
    counted = chosen.where("last").drop("slot", "begin", "end", "last").withColumnRenamed("conv_id", "counted_conv")
    # Distinct turns are counted in two steps, so that no conversation's rows meet in one task.
    spans = ordered.groupBy(F.col("conv_id").alias("spanned_conv")).agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("n"))
    gaps = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.try_subtract(F.try_add(F.try_subtract("most", "least"), F.lit(1)), F.col("n")))
    out = texts.join(counted, F.col("conv_id").eqNullSafe(F.col("counted_conv"))).join(spans, F.col("conv_id").eqNullSafe(F.col("spanned_conv")))
    return out.select("conv_id", gaps.cast("long").alias("gaps"), *_COUNTS[1:], "audit", "repaired_sha256")


def _table(made: list[dict], id_type: pa.DataType, key: str, *more) -> pa.Table:
    lists, longs = [(c, pa.list_(pa.int32())) for c in ("costs", "ranks")], [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    return pa.Table.from_pylist(made, pa.schema([("conv_id", id_type), (key, pa.int64()), *lists, *longs, ("first", pa.string()), ("last", pa.string()), *more]))


def _repaired(conversations: DataFrame, turns: bool, long_rows: int, long_bytes: int) -> DataFrame:
    there = _with_tie(conversations)
    sizes = there.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("role").cast("long") + F.octet_length("text")).alias("bytes"))
    large = durable(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("large_conv")))
    if not large.head(1):
        return _whole(there, turns)
    same = F.col("conv_id").eqNullSafe(F.col("large_conv"))
    small = _whole(there.join(few(large), same, "left_anti"), turns)
    cut = _cut_and_joined(there.where(~F.col("gone")).join(few(large), same, "left_semi").drop("gone"), turns, long_rows, long_bytes)
    if turns:
        return small.unionByName(cut)
    # A large conversation may have lost all its rows.
    zeros = {c: F.coalesce(c, F.lit(0)) for c in _COUNTS[1:]} | {"gaps": F.when(F.col("repaired_sha256").isNull(), 0).otherwise(F.col("gaps"))}
    texts = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    cut = large.join(cut, same, "left").select(F.col("large_conv").alias("conv_id"), *[(zeros | texts)[c].alias(c) for c in (*_COUNTS, "audit", "repaired_sha256")])
    return small.unionByName(cut)


def repaired(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired rows of ``conversations(conv_id, turn, role, text)``: ``(conv_id, part, place, action, role, text)``.

    Within a conversation they go by (part, place). ``action`` is K (kept), R (another role) or I (inserted); deleted rows are not there.
    """
    return _repaired(conversations, True, long_rows, long_bytes)


def repair_report(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation, as in op13: faults, cost and letters of the edits, and the hash of the repaired rows.

    A boolean column ``gone``, if there, marks rows that count for nothing but the list of conversations.
    """
    return _repaired(conversations, False, long_rows, long_bytes)


def damage(conversations: DataFrame) -> DataFrame:
    """Damage rows by a hash of conversation and turn; rows that it drops stay, as ``gone``."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    there = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return there.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("copy")
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))


def queries():
    return {"op13_conversation_repair": op13_conversation_repair}

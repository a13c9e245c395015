"""Conversation repair against a search through all edits, and in segments against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from shared import SF, table_rows

from fansieve.llm import conversations as C

EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(initials, faults):
    """Least (cost, audit, names) by breadth over all edits: states are (rows done, what was written last)."""
    rank = {"": 0, "s": 0, "u": 1, "a": 0}
    best = {("", 0): (0, "", ())}
    done = []
    for row in range(len(initials) + 1):
        # At most two inserts in a row are ever of use; three are allowed here.
        for _ in range(3):
            for (last, r), (cost, audit, out) in list(best.items()):
                if r == row:
                    name = "a" if rank[last] else "u"
                    add(best, (name, row), (cost + 5, audit + "I", (*out, name)))
        if row == len(initials):
            break
        for (last, r), (cost, audit, out) in list(best.items()):
            if r != row:
                continue
            add(best, (last, row + 1), (cost + 2, audit + "D", out))
            if faults[row] in (C.BLANK, C.DUPLICATE):
                continue
            more = 5 if faults[row] == C.TRUNCATED else 0
            may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
            if initials[row] in may:
                add(best, (initials[row], row + 1), (cost + more, audit + "K", (*out, initials[row])))
            for name in "ua":
                if name in may:
                    add(best, (name, row + 1), (cost + 1 + more, audit + "R", (*out, name)))
    done = [best[(last, len(initials))] for last in ("", "a") if (last, len(initials)) in best]
    return min(done)


def add(best, key, value):
    if key not in best or value < best[key]:
        best[key] = value


def test_automaton_accepts_the_language():
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            ways = C.parse(C._TOPS[0], word, [C.NONE] * n)
            cost, audit = C.finish(ways)
            assert (cost == 0) == bool(re.fullmatch("(s?(ua)+)?", word)), word


@pytest.mark.parametrize("seed", range(300))
def test_cheapest_edits(seed):
    r = random.Random(seed)
    n = r.randrange(0, 14)
    initials = "".join(r.choice("ssuuuaaa-") for _ in range(n))
    faults = [r.choice([0, 0, 0, 0, 1, 2, 3, 3]) for _ in range(n)]
    cost, audit, names = cheapest(initials, faults)
    assert C.finish(C.parse(C._TOPS[0], initials, faults)) == (cost, audit)
    made = [{"user": "u", "assistant": "a", None: "s"}[name] if k is None or name else initials[k] for k, _, name in C.apply(0, audit, initials)]
    assert tuple(made) == names and re.fullmatch("(s?(ua)+)?", "".join(made))


def first_characters(role, text):
    return f"{role[:16]}:{text[:48]}:" + hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if key == 0:
            continue
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        kept += [(turn, "user" if key == 4 else role, text)] * (2 if key == 3 else 1)
    return out


def plain(rows):
    """The report by the text of the task."""
    out = {}
    for conv, held in damaged(rows).items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, first_characters(r[1], r[2])))
        faults, seen = [], set()
        for _, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = "".join(role[:1] if role[:1] in ("s", "u", "a") and role else "-" for _, role, _ in held)
        cost, audit, names = cheapest(initials, faults)
        made, k = [], iter(names)
        rows_left = iter(held)
        for letter in audit:
            row = None if letter == "I" else next(rows_left)
            if letter != "D":
                name = {"u": "user", "a": "assistant", "s": "system"}[next(k)]
                made.append(f"{row[1] if letter == 'K' else name}:{row[2] if row else ''}")
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def report(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_query(spark):
    df = C.op13_conversation_repair(spark, SF)
    assert df.dtypes == [("conv_id", "bigint"), *[(c, "bigint") for c in C._COUNTS], ("audit", "string"), ("repaired_sha256", "string")]
    want = plain(table_rows(spark, "conversations", "conv_id, turn, role, text"))
    assert report(df) == want
    assert any(w[5] for w in want.values())


KIND = "conv_id long, turn long, role string, text string, gone string, n int, `a.b` string"


def awkward():
    r = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(r.randrange(1, 30)):
            text = r.choice([None, "", " \t", "Yes.", "No!", "Cut off", "é 日本?", "x" * 50 + str(turn) + ".", "Same."])
            rows.append((conv, r.choice([turn, turn, turn, None, 3]), r.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), text))
    return rows + rows[:20] + [(99, None, None, None), (98, 2**62, "user", "A."), (98, -(2**62) + 5, "assistant", "B.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "dot") for r in rows], KIND)


def test_awkward_rows_and_segments(spark):
    rows = awkward()
    want = plain(rows)
    whole = C.damage(frame(spark, rows))
    assert report(C.repair_report(whole)) == want
    # Segments of three rows at most, and of a few bytes.
    assert report(C.repair_report(whole, long_rows=3)) == want
    assert report(C.repair_report(whole, long_rows=7, long_bytes=40)) == want


def test_repaired_rows(spark):
    rows = awkward()
    there = C.damage(frame(spark, rows))
    for long_rows in (3, 4096):
        found = {}
        for r in C.repaired(there, long_rows=long_rows).orderBy("part", "place").collect():
            found.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for conv, row in plain(rows).items():
            assert hashlib.sha256("\n".join(found.get(conv, [])).encode()).hexdigest() == row[-1]


def test_one_conversation_of_many_rows(spark):
    rows = [(1, t // 2 if t % 7 == 0 else t, ["user", "assistant", "user"][t % 3], f"Row {t % 400}{'.' if t % 5 else ''}") for t in range(3000)]
    there = C.damage(frame(spark, rows))
    assert report(C.repair_report(there, long_rows=100)) == plain(rows) == report(C.repair_report(there))


def test_nothing_left(spark):
    assert C.repair_report(C.damage(frame(spark, []))).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    there = C.damage(frame(spark, [(5, dropped, "user", "Hello.")] * 6))
    for long_rows in (3, 100):
        assert report(C.repair_report(there, long_rows=long_rows)) == {5: (0, 0, 0, 0, 0, 0, "", EMPTY)}

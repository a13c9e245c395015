import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from shared import LONG, SF, documents, nothing, prose, table_rows

from fansieve.llm import edit_fingerprints as ef
from fansieve.llm.arrow import strings


def fingerprint(text):
    return ef._Edited(strings(pa.array([text, ""]))).fingerprint[0]


def plain(text):
    """The walk, one character at a time."""
    w, t, at, shown = ef.walks(), 0, 0, []
    kinds, _, _ = ef.characters(strings(pa.array([text])))
    while at < len(kinds):
        stay = w.stay[kinds[at], t % ef.PERIOD]
        shown += [kinds[at]] * int(stay)
        t += int(stay)
        at += 1
    level = max(0, int(np.ceil(np.log2(max(1, t) / ef.TIMES))))
    w.prepare(t)
    return level, [shown[i] for i in range(t) if w.level[i] >= level]


def changed(text, k, seed):
    r, y = random.Random(seed), list(text)
    for _ in range(k):
        p = r.randrange(len(y))
        if r.random() < 0.5:
            y[p] = "q"
        elif r.random() < 0.5:
            y.insert(p, "z")
        else:
            del y[p]
    return "".join(y)


def test_walks_side_by_side_are_walks_alone():
    texts = [prose(k, 5 + 7 * k) for k in range(90)] + ["", "é", "日本語"]
    held = ef._Edited(strings(pa.array([*texts, ""])))
    for t, f in zip(texts, held.fingerprint, strict=True):
        level, shown = plain(t)
        digits = (ef.mix(np.arange(ef.KINDS, dtype=np.uint64) + np.uint64(0x5A)) & np.uint64(15)).astype(int)
        assert f == f"{level}." + "".join("0123456789abcdef"[digits[c]] for c in shown)


def test_a_text_may_be_of_any_length():
    """One character more than 32-bit clocks are safe for."""
    kinds = np.random.default_rng(3).integers(0, ef.KINDS, 2**31 // 64 + 1).astype(np.uint8)
    w, size = ef.Walks(), np.array([len(kinds)])
    begin, end = w.walk(kinds, np.array([0]), size)
    for at in range(0, len(kinds), 1 << 20):
        came, some = begin[at : at + (1 << 20) + 1], kinds[at : at + (1 << 20)]
        came = np.append(came, end) if len(came) == len(some) else came
        assert (np.diff(came) == w.stay[some, came[:-1] & (ef.PERIOD - 1)]).all()
    ((level, shown),) = w.fingerprints(kinds, np.array([0]), size)
    assert level == int(np.ceil(np.log2(int(end[0]) / ef.TIMES))) and 0.3 * ef.TIMES < len(shown) < 1.5 * ef.TIMES


def test_the_query_agrees_with_a_plain_version(spark):
    rows = sorted(table_rows(spark, "documents", "doc_id, text"))
    found = {r.doc_id: r for r in ef.op2_edit_fingerprints(spark, SF).collect()}
    assert len(found) == len(rows)
    by_text = {}
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        made = t[: len(t) - half] + after[:half]
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(made.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(made, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited > r.near_next for r in found.values()]) > 0.97
    assert np.median([r.near_edited for r in found.values()]) > 0.45


def test_awkward_rows(spark):
    found = sorted(ef.fingerprints_in_order(documents(spark)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = [prose(3, 40), prose(2, 120), "", "", "  \n\t ", LONG, prose(2, 120), prose(2, 120), "one two", "\x00 a\x00b é 日本語 12 !!", prose(4, 80).upper(), "x"]
    assert [r.n_chars for r in found] == [len(t) for t in texts]
    for k, t in enumerate(texts):
        half, after = len(t) // 2, texts[(k + 1) % len(texts)]
        assert found[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert found[k].fingerprint == fingerprint(t)
    assert found[2].near_next == 1.0 and found[6].near_next == 1.0 and found[1].near_next == 0.0


def test_no_row_and_one_row(spark):
    assert ef.fingerprints_in_order(nothing(spark)).collect() == []
    (r,) = ef.fingerprints_in_order(documents(spark, [(4, "abcd", "en", "a")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_few_edits_leave_fingerprints_alike():
    w = ef.walks()
    like = []
    for k in range(40):
        t = prose(k, 300)
        like.append(w.likeness(ef.read(fingerprint(t)), ef.read(fingerprint(changed(t, 2, k)))))
    assert np.median(like) > 0.9
    far = [w.likeness(ef.read(fingerprint(prose(k, 300))), ef.read(fingerprint(prose(k + 1000, 600)))) for k in range(20)]
    assert max(far) < 0.4


def test_near_texts(spark):
    texts = [prose(k, 200 + 10 * k) for k in range(30)]
    near = [t[:100] + "#" + t[100:] for t in texts[:10]]
    prints = [fingerprint(t) for t in [*texts, *near, texts[20], "", ""]]
    rows = spark.createDataFrame(list(enumerate(prints)), "row long, fingerprint string")
    found = {r.row: r.class_row for r in ef.near_texts(rows).collect()}
    assert len(found) == 43
    w = ef.walks()
    for k in range(30):
        assert found[k] == k
    for k in range(10):
        like = w.likeness(ef.read(prints[k]), ef.read(prints[30 + k]))
        assert found[30 + k] == (k if like >= ef.LIKE else 30 + k)
    assert sum(found[30 + k] == k for k in range(10)) >= 7
    assert found[40] == 20 and found[42] == 41
    assert ef.near_texts(rows.where(F.lit(False))).collect() == []

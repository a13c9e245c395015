import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fansieve.llm.arrow import ALPHANUMERIC, BY_WHITE, BY_WHITE_LOWER, Words, distinct, shingles, slices, strings, word_hash

texts = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aB \n\té\x00.-9日", max_size=60)), max_size=8)


def array(values):
    return strings(pa.array(values, pa.string()))


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(values):
    plain = [v or "" for v in values]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), v) for v in plain]
    for split, pattern, source in (
        (BY_WHITE, r"[^\x20\x09-\x0D]+", plain),
        (BY_WHITE_LOWER, r"[^\x20\x09-\x0D]+", low),
        (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low),
    ):
        words = Words(array(values), split)
        want = [re.findall(pattern, v) for v in source]
        assert words.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert [words.text(i) for i in range(len(flat))] == flat
        by_word = dict(zip(flat, words.hash.tolist(), strict=True))
        assert len(set(by_word.values())) == len(by_word)
        assert all(by_word[w] == h for w, h in zip(flat, words.hash.tolist(), strict=True))


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 6))
def test_shingles_are_runs_of_words(values, size):
    doc, h = shingles(Words(array(values), BY_WHITE), size)
    want = []
    for d, v in enumerate(values):
        w = re.findall(r"[^\x20\x09-\x0D]+", v or "")
        runs = [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
        want += [(d, r) for r in runs]
    assert doc.tolist() == [d for d, _ in want]
    meaning = {}
    for x, (_, r) in zip(h.tolist(), want, strict=True):
        assert meaning.setdefault(x, r) == r
    assert len(meaning) == len({r for _, r in want})


def test_slices_and_sliced_arrays_agree():
    values = ["a b", None, "c" * 50, "", "d e f", "g"] * 5
    whole = Words(array(values), BY_WHITE)
    parts = [Words(s, BY_WHITE) for _, s in slices(array(values).slice(2, 20), 40)]
    assert np.concatenate([p.hash for p in parts]).tolist() == Words(array(values[2:22]), BY_WHITE).hash.tolist()
    assert len(whole.hash) == sum(len((v or "").split()) for v in values)
    assert sum(len(s) for _, s in slices(array(values), 1)) == len(values)


def test_distinct():
    h = np.array([5, 3, 5, 9, 3], np.uint64)
    values, where, number = distinct(h)
    assert values.tolist() == [3, 5, 9] and h[where].tolist() == [3, 5, 9] and values[number].tolist() == h.tolist()
    assert [len(x) for x in distinct(h[:0])] == [0, 0, 0]
    assert word_hash("a", "b", "a").tolist()[0] == word_hash("a").tolist()[0]

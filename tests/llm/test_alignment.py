"""Alignment of tokenizers against a plain walk over both lists of ends."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from shared import SF, TEXTS, documents, nothing, prose, table_rows
from tokenizers import Tokenizer

from fansieve.llm import alignment as L
from fansieve.llm.arrow import BY_WHITE, HASHED_BYTES, Words

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
a_tokenizer = Tokenizer.from_file(A)
a_tokenizer.encode_special_tokens = True
b_tokenizer = SentencePieceProcessor(model_file=B)
SIDES = L.Side.byte_level(open(A, encoding="utf-8").read()), L.Side.sentencepiece(open(B, "rb").read())


def plain_tokens(text):
    """Ids of both, whole text at once; none if the bytes do not come back."""
    if not text:
        return [], []
    a = a_tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = b_tokenizer.encode(text)
    want = (" " + text).encode()
    if any(b"".join(side.pieces[k] for k in ids) != want for side, ids in zip(SIDES, (a, b), strict=True)):
        return [], []
    return a, b


def plain_groups(a, b):
    groups, group, n_a, n_b = [], ([], []), 0, 0
    a, b = list(a), list(b)
    while a or b:
        if n_a <= n_b and a:
            n_a += len(SIDES[0].pieces[a[0]])
            group[0].append(a.pop(0))
        else:
            n_b += len(SIDES[1].pieces[b[0]])
            group[1].append(b.pop(0))
        if n_a == n_b:
            groups.append(group)
            group = ([], [])
    return groups


def plain_report(texts):
    held = [(d, *plain_tokens(t)) for d, t in texts]
    groups = [plain_groups(a, b) for _, a, b in held]
    links = [[(x[-1], y[-1]) for x, y in some] for some in groups]
    count = Counter(p for some in links for p in some)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for (d, a, b), some, pairs in zip(held, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in some)
        digest = hashlib.sha256(text.encode()).hexdigest() if some else ""
        out.append((d, len(a), len(b), len(some), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    return Counter(out)


HARD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "a \nb", "é à", "x  y", "x  y", "x    y", "　 a 　b", "日本 語 テ キスト", "▁a ▁ b", "a ▁▁ b",
    "<|endoftext|> <s> </s> <unk> <0x41>", "don't can 't 's", "\x00 \x1f a\x7f b", "\u0085 a \u0085 b", "🙂 🙂🙂 x", "ﬁ x", "á é", "100 000 12 3", "...  !! ?", "﻿ a", "a\tb \t c",
]


def random_text(seed):
    r = random.Random(seed)
    pieces = [" ", " ", "  ", "\n", "\t", " ", " ", "é", "à", "语", "▁" if seed % 5 == 0 else "z", "🙂", "word", "The", "'s", "12", ".", "\x1f", "Â", "ã"]
    return "".join(r.choice(pieces) for _ in range(r.randrange(1, 60)))


def test_stretches_are_tokenised_as_in_their_texts():
    texts = HARD + [random_text(k) for k in range(3000)]
    align = L.Aligner(*SIDES)
    x, _ = align(pa.array(texts, pa.large_string()), work=7)
    for k, text in enumerate(texts):
        a, b = plain_tokens(text)
        assert (x.a_ids[x.a_first[k] : x.a_first[k + 1]].tolist(), x.b_ids[x.b_first[k] : x.b_first[k + 1]].tolist()) == (a, b), repr(text)


@pytest.mark.parametrize("work", [1, 2, 3, 10, 1000])
def test_merge_path(work):
    r = random.Random(work)
    for _ in range(200):
        total = r.randrange(0, 60)
        a, b = (np.array(sorted({*r.sample(range(1, total + 1), r.randrange(0, total)), total} if total else []), np.int64) for _ in "ab")
        i, j = L.diagonals(a, b, work)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i + j) <= work + 1).all()
        assert all(not (0 < x and y < len(b) and a[x - 1] == b[y]) for x, y in zip(i, j, strict=True))
        ends = sorted({*a.tolist(), *b.tolist()})
        want = [(int(np.searchsorted(a, e)), int(np.searchsorted(b, e)), e in a and e in b) for e in ends]
        found = L.overlaps(a, b, work)
        assert list(zip(*(c.tolist() for c in found), strict=True)) == want
        # Every byte of every overlap lies in both tokens.
        assert [(x, y) for x, y, _ in want] == [
            (x, y) for x, y in itertools.product(range(len(a)), range(len(b))) if max([0, *a][x], [0, *b][y]) < min(a[x], b[y])
        ]


def check(df, texts):
    assert Counter(tuple(r) for r in df.collect()) == plain_report(texts)


def test_query(spark):
    df = L.op12_token_alignment(spark, SF)
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    assert df.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in longs], ("groups_sha256", "string")]
    check(df, table_rows(spark, "documents", "doc_id, text"))


ROWS = TEXTS + [(100 + k, t, None, None) for k, t in enumerate(HARD)]


@pytest.mark.parametrize(("head", "most"), [(L.HEAD, L.PART_BYTES), (0, 300), (200, 20)])
def test_awkward_rows_rare_pairs_and_parts(spark, head, most):
    check(L.alignment_report(documents(spark, ROWS), A, B, head=head, most=most), [r[:2] for r in ROWS])


def test_nothing(spark):
    assert L.alignment_report(nothing(spark), A, B).collect() == []
    assert L.alignments(nothing(spark), A, B).collect() == []


def test_real_output(spark):
    for part in (L.PART_BYTES, 64):
        found = {r["doc_id"]: r for r in L.alignments(documents(spark, ROWS[:5] + ROWS[7:]), A, B, most=part).collect()}
        for d, text, *_ in ROWS[:5] + ROWS[7:]:
            r, (a, b) = found[d], plain_tokens(text)
            groups = plain_groups(a, b)
            assert (r["a_ids"], r["b_ids"]) == (a, b)
            assert (r["a_sizes"], r["b_sizes"]) == ([len(x) for x, _ in groups], [len(y) for _, y in groups])
            ends = [np.cumsum([len(side.pieces[k]) for k in ids], dtype=np.int64) for side, ids in zip(SIDES, (a, b), strict=True)]
            want = L.overlaps(*ends)
            assert (r["a_overlaps"], r["b_overlaps"]) == (want.a.tolist(), want.b.tolist())


def test_forgetting_changes_nothing(monkeypatch):
    texts = pa.array([prose(k, 200) for k in range(30)], pa.large_string())
    want, _ = L.Aligner(*SIDES)(texts)
    monkeypatch.setattr(L, "REMEMBERED", 100)
    align = L.Aligner(*SIDES)
    for _ in range(2):
        ids = [align(texts.slice(k, 1))[0].a_ids for k in range(30)]
        assert np.concatenate(ids).tolist() == want.a_ids.tolist()


def test_long_words_have_the_hash_of_short_ones(monkeypatch):
    texts = pa.array(["a " + "xyz" * 5000 + " b " + "q" * 20_000, "xyz" * 5000], pa.large_string())
    want = Words(texts, BY_WHITE).hash
    assert HASHED_BYTES > 20_000
    monkeypatch.setattr("fansieve.llm.arrow.HASHED_BYTES", 1000)
    assert Words(texts, BY_WHITE).hash.tolist() == want.tolist()

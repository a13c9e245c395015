import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shared import SF, documents, nothing, table_rows
from tokenizers import Tokenizer

from fansieve.llm import packing
from fansieve.llm.arrow import strings

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def by_words():
    return packing.WordTokens(open(PATH, encoding="utf-8").read())


def check(found, texts, tokenizer):
    """Every id of every document lies in one piece; sequences have no gaps and are short enough."""
    ids = defaultdict(list)
    for d, t in texts:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r["offset"], r.length))
    assert set(pieces) == set(ids)
    for d, rows in pieces.items():
        assert {r.doc_tokens for r in rows} == {len(ids[d][0])}
        held = np.zeros(len(ids[d][0]), int)
        for r in rows:
            part = ids[d][0][r.start : r.start + r.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length > 0
            held[r.start : r.start + r.length] += 1
        assert (held == len(ids[d])).all()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    return sum(len(i[0]) * len(i) for i in ids.values()) / (packing.LENGTH * len(sequences))


def test_the_query(spark, tokenizer):
    assert check(packing.op8_packing(spark, SF).collect(), table_rows(spark, "documents", "doc_id, text"), tokenizer) > 0.97


def test_many_tasks_leave_little_padding(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(40)
    assert check(packing.pack_documents(docs, PATH).collect(), table_rows(spark, "documents", "doc_id, text"), tokenizer) > 0.97


def test_awkward_rows(spark, tokenizer):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(packing.pack_documents(docs, PATH).collect(), rows, tokenizer)
    assert packing.pack_documents(nothing(spark), PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aBc'stdlrevm.,!|<>#é́İΣ1 \n\x00", max_size=40)), max_size=5))
def test_ids_are_those_of_whole_texts(tokenizer, by_words, texts):
    texts = [*texts, "it's O'Neill.'s don't.. a.b,c !?.x", "<|endoftext|>the<|startoftext|> <|ENDOFTEXT|>"]
    for some in (texts, texts[:-1]):
        flat, counts = by_words(strings(pa.array(some, pa.string())))
        ends = np.cumsum(counts)
        for t, e, n in zip(some, ends, counts, strict=True):
            assert flat[e - n : e].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_what_is_remembered_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    w = packing.WordTokens(open(PATH, encoding="utf-8").read())
    for k in range(5):
        text = " ".join(f"word{k}{i}" for i in range(15))
        flat, _ = w(strings(pa.array([text])))
        assert flat.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2] and len(w.known) <= 20


def test_costs_are_balanced():
    r = np.random.default_rng(1)
    pieces = [packing.Piece(k, 0, np.zeros(n, np.uint32), n) for k, n in enumerate(r.integers(1, 9000, 800).tolist())]
    sequences, left = packing.pack(pieces, 4096, last=False)
    assert all(sum(len(p.ids) for p in s) == 4096 for s in sequences) and sum(len(p.ids) for p in left) < 4096

    def costs(dealt):
        return [sum(packing.LINEAR * n + packing.QUADRATIC * n * n for n in s) for s in dealt if len(s) > 1]

    # Against each document in the fullest sequence that still has room for it.
    fullest = []
    for n in sorted((len(p.ids) % 4096 for p in pieces), reverse=True):
        fit = [s for s in fullest if sum(s) + n <= 4096]
        max(fit, key=sum).append(n) if fit else fullest.append([n])
    ours = costs([[len(p.ids) for p in s] for s in sequences])
    print(np.std(ours), np.max(ours), np.std(costs(fullest)), np.max(costs(fullest)), len(fullest), len(sequences))
    assert np.std(ours) < np.std(costs(fullest))

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from shared import SF, SF_2, documents, lower, nothing, table_rows, white_words

from fansieve.llm import language_model as lm


def tokens(text):
    return [*white_words(lower(text)), ("end",)]


def base(rows):
    count = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            count.update(tokens(t))
    total, types = sum(count.values()), len(count)
    return {
        d: (len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w))
        for d, w in ((d, tokens(t)) for d, t in rows)
    }


@pytest.mark.parametrize("head", [lm.HEAD, 300])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head,))
    rows = table_rows(spark, "documents", "doc_id, text")
    want = base(rows)
    found = lm.op7_language_model(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score < 0


def test_held_out_texts_are_likelier_than_by_counts_alone(spark):
    found = [r for r in lm.op7_language_model(spark, SF_2).collect() if r.held_out]
    assert sum(r.score for r in found) > 0.99 * sum(r.base_score for r in found)
    assert np.mean([r.score > r.base_score for r in found]) > 0.9


def small_vocabulary(n=70, seed=0):
    r = np.random.default_rng(seed)
    h = np.sort(r.integers(1, 2**62, n).astype(np.uint64))
    h[0] = lm.END
    counts = r.integers(2, 900, n)
    place = np.empty(n, np.int64)
    place[np.lexsort((h, -counts))] = np.arange(n)
    return lm.Vocabulary(h, counts, place, int(counts.sum()) + 50, n + 50)


def test_probabilities_of_all_words_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    v = small_vocabulary()
    net = lm.Network(v)
    h = np.random.default_rng(3).standard_normal((4, lm.STATE)).astype(np.float32)
    total = np.zeros(4)
    for w in range(len(v.hashes)):
        total += np.exp(net.log_probability(v, h, np.full(4, w)))
    # The tail's words share their class by count plus one; with one unseen word that is all of it.
    tail = np.exp(net.log_probability(v, h, np.full(4, len(v.hashes)))) * np.exp(v.log_mass[v.rest])
    assert np.allclose(total + tail, 1, atol=1e-4)


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    v = small_vocabulary()
    net = lm.Network(v)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    r = np.random.default_rng(4)
    word = r.integers(0, len(v.hashes), (5, 3))
    before = v.word_input[r.integers(0, len(v.hashes), (5, 3))]
    h = r.standard_normal((3, lm.STATE))
    # Texts begin inside the window too.
    fresh = np.array([[0, 1, 0], [0, 0, 0], [1, 0, 0], [0, 0, 1], [0, 0, 0]], bool)
    g, _, _ = net.gradients(v, before, word, h, fresh)
    for k in net.NAMES:
        x = getattr(net, k)
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in x.shape)
            old, losses = x[at], []
            for d in (1e-5, -1e-5):
                x[at] = old + d
                losses.append(net.gradients(v, before, word, h, fresh)[2])
            x[at] = old
            assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=2e-5)


def test_the_state_goes_on_from_window_to_window(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    v = small_vocabulary()
    net = lm.Network(v)
    r = np.random.default_rng(5)
    texts = [np.append(r.integers(1, len(v.hashes) + 1, n), 0) for n in (0, 3, 200, 77, 1, 0, 64)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = lm.score_texts(net, v, np.concatenate(texts), first)
    for t, g in zip(texts, got, strict=True):
        h, before, want = np.zeros((1, lm.STATE), np.float32), v.start, 0.0
        for w in t:
            h, _ = net.step(net.projected()[[before]], h)
            want += net.log_probability(v, h, np.array([w]))[0]
            before = v.word_input[w]
        assert g == pytest.approx(want, rel=1e-4)
    assert len(lm.score_texts(net, v, np.zeros(0, np.int64), np.zeros(1, np.int64))) == 0


def test_training_begins_each_text_anew(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    v = small_vocabulary()
    net = lm.Network(v)
    r = np.random.default_rng(8)
    texts = [np.append(r.integers(1, len(v.hashes), n), 0) for n in (2, 5, 0, 6)]
    word = np.concatenate(texts)
    # All in one stream, and in one window.
    fresh = np.concatenate([[True], word[:-1] == 0])
    before = np.where(fresh, v.start, np.concatenate([[0], v.word_input[word[:-1]]]))
    h = r.standard_normal((1, lm.STATE)).astype(np.float32)
    loss = net.gradients(v, before[:, None], word[:, None], h, fresh[:, None])[2]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    common = v.word_class[word] >= v.learned
    inside = (v.log_mass[v.word_class[word]] - v.log_count[word])[common].sum()
    assert -loss * len(word) - inside == pytest.approx(lm.score_texts(net, v, word, first).sum(), rel=1e-4)


def test_training_learns_what_follows_what(monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    monkeypatch.setattr(lm, "STREAMS", 16)
    v = small_vocabulary()
    r = np.random.default_rng(6)
    start = r.integers(1, 30, 30_000)
    word = np.stack([start, start + 1], axis=1).ravel()
    learner = lm.Learner(v, lm.Network(v))
    learner.feed(word)
    assert learner.tokens == learner.by_input.sum() == learner.by_class.sum() == len(word)
    test = np.array([5, 6, 9, 10, 22, 23])
    other = np.array([5, 20, 9, 3, 22, 8])
    assert lm.score_texts(learner.net, v, test, np.array([0, 6]))[0] > lm.score_texts(learner.net, v, other, np.array([0, 6]))[0] + 4


def test_no_token_is_left_out_and_averages_are_exact():
    v = small_vocabulary()
    for n in (0, 1, 5, 33, 1000):
        learner = lm.Learner(v, lm.Network(v))
        learner.feed(np.random.default_rng(n).integers(0, len(v.hashes), n))
        assert learner.tokens == n
    weighted, spoke = learner.sums()
    again = lm.averaged(lm.Network(v), 3 * weighted, 3 * spoke)
    for k in again.NAMES:
        assert np.allclose(getattr(again, k), getattr(learner.net, k), atol=1e-6)
    untouched = learner.by_input == 0
    assert untouched.any() and np.array_equal(again.embed[untouched], lm.Network(v).embed[untouched])


def test_what_stands_in_the_last_partition_only_is_learned(spark, monkeypatch):
    monkeypatch.setattr(lm, "TREE", 3)
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 60, 80)) for _ in range(700)]
    # Another language, in which each word tells the next.
    texts += [" ".join(f"z{(k + i) % 40}" for i in range(80)) for k in r.integers(0, 40, 100)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(8, "doc_id")
    found = [x for x in lm.score(docs).collect() if x.held_out and x.doc_id >= 700]
    assert len(found) > 5 and sum(x.score for x in found) > 0.8 * sum(x.base_score for x in found)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = base(rows)
    found = lm.score(docs).collect()
    assert len(found) == 12
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3])
        assert math.isfinite(r.score) and r.score < 0
    assert lm.score(nothing(spark)).collect() == []

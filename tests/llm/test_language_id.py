import itertools
import zlib

import numpy as np
import pyarrow as pa
from shared import SF_2, documents, nothing, table_rows

from fansieve.llm import language_id as li
from fansieve.llm.arrow import strings
from fansieve.llm.sampling import bounded_classes

TEXTS = {
    "en": "the river was cold and the winter had been long with snow on the hills and no wind from the north",
    "de": "der fluss war kalt und der winter war lang mit schnee auf den bergen und kein wind aus dem norden",
    "fr": "la rivière était froide et le long hiver avait laissé de la neige sur les collines sans aucun vent",
}


def test_forward_backward_is_the_sum_over_all_labellings():
    r = np.random.default_rng(2)
    evidence, move, begin = r.random((5, 3)) + 0.1, r.random((3, 3)) + 0.1, r.random(3) + 0.1
    word, first, size = np.array([0, 3, 2, 4, 1, 1]), np.array([0, 4]), np.array([4, 2])
    got = li.marginals(evidence, word, first, size, move, begin)
    for f, n in zip(first, size, strict=True):
        want = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            p = begin[labels[0]]
            for t, y in enumerate(labels):
                p *= evidence[word[f + t], y] * (move[labels[t - 1], y] if t else 1)
            want[np.arange(n), labels] += p
        assert np.allclose(got[f : f + n], want / want.sum(axis=1, keepdims=True))


def test_expected_moves_are_the_sum_over_all_labellings():
    r = np.random.default_rng(3)
    evidence, move, begin = r.random((5, 3)) + 0.1, r.random((3, 3)) + 0.1, r.random(3) + 0.1
    word, first, size = np.array([0, 3, 2, 4, 1, 1, 2]), np.array([0, 4, 6]), np.array([4, 2, 1])
    _, got = li.forward_backward(evidence, word, first, size, move, begin, pairs=True)
    want = np.zeros((3, 3))
    for f, n in zip(first, size, strict=True):
        total, moved = 0.0, np.zeros((3, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            p = begin[labels[0]]
            for t, y in enumerate(labels):
                p *= evidence[word[f + t], y] * (move[labels[t - 1], y] if t else 1)
            total += p
            for a, b in itertools.pairwise(labels):
                moved[a, b] += p
        want += moved / total
    assert np.allclose(got, want, atol=1e-9)


def test_samples_are_the_same_whatever_the_order(spark):
    rows = [(k % 50, f"text {k % 7}", "en" if k % 3 else "de") for k in range(600)] + [(None, "x", "fr")] * 300 + [(1, "y" * (2 << 20), "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = bounded_classes(df.repartition(7), "lang", 20)
    assert one == bounded_classes(df.repartition(3, "text"), "lang", 20)
    assert {lang for lang, _ in one} == {"en", "de", "fr"} and [t for lang, t in one if lang == "fr"] == ["x"]


def test_it_labels_words_of_mixed_texts():
    field = li.train([(lang, " ".join(text.split()[k:] + text.split()[:k])) for lang, text in TEXTS.items() for k in range(12)])
    assert field.labels == ["de", "en", "fr"]
    mixed = TEXTS["en"] + " " + TEXTS["en"] + " " + TEXTS["de"]
    langs, score, words, switches = li.label_texts(field, strings(pa.array([mixed, TEXTS["fr"], "", None, "12 ?!", "«—»"])))
    assert langs == ["en", "fr", "und", "und", "und", "und"]
    assert 0.6 < score[0] < 0.75 and score[1] > 0.9 and score[2:].tolist() == [0] * 4
    assert switches[0] == 1 and words[0] == len(mixed.split())
    # Learned transitions: to stay is likelier than to switch.
    assert all(field.move[k, k] == field.move[k].max() for k in range(3))


def test_held_out_accuracy_of_the_query(spark):
    truth = dict(table_rows(spark, "documents", "doc_id, lang", SF_2))
    found = li.op3_language_id(spark, SF_2).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in found)


def test_awkward_rows(spark):
    docs = documents(spark)
    found = li.identify(docs, docs).collect()
    assert len(found) == 12
    by_doc = {r.doc_id: r for r in found}
    assert [by_doc[d].lang_pred for d in (1, 2, 3)] == ["und"] * 3 and by_doc[1].score == 0
    assert by_doc[4].lang_pred == "en" and by_doc[4].words == 30_000
    left = li.with_language(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()}.isdisjoint({1, 2, 3})


def test_nothing_to_learn_from(spark):
    assert li.identify(nothing(spark), nothing(spark)).collect() == []
    assert {r.lang_pred for r in li.identify(documents(spark), nothing(spark)).collect()} == {"und"}

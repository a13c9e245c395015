import random
from collections import defaultdict

import numpy as np
from shared import SF, documents, nothing, prose, table_rows, white_words

from fansieve.llm import near_duplicates as nd


def plain_classes(texts, similarity=0.8):
    """Classes by comparing all texts that share a shingle."""

    def runs(t):
        w = white_words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [runs(t) for t in texts]
    of = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of[x].append(i)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    tried = set()
    for same in of.values():
        for k, i in enumerate(same):
            for j in same[k + 1 :]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                        a, b = sorted((find(i), find(j)))
                        top[b] = a
    return [find(i) for i in range(len(sets))]


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for _ in range(max(1, int(share * len(w)))):
        w[r.randrange(len(w))] = f"new{r.randrange(10**9)}"
    return " ".join(w)


def test_the_query_finds_the_classes_of_brute_force(spark):
    rows = sorted(table_rows(spark, "documents", "doc_id, text"))
    want = plain_classes([t for _, t in rows])
    found = {r.doc_id: r for r in nd.op1_near_duplicates(spark, SF).collect()}
    assert len(found) == len(rows)
    assert [found[d].class_id for d, _ in rows] == [rows[c][0] for c in want]
    assert sum(r.kept for r in found.values()) == len(set(want))


def test_a_family_of_near_copies(spark):
    base = prose(77, 200)
    texts = [base, *[edited(base, k, 0.015) for k in range(60)], *[edited(base, k, 0.08) for k in range(60, 90)], *[prose(500 + k, 120) for k in range(40)]]
    want = plain_classes(texts)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    # Also with buckets split as very large ones are.
    for together in (nd.TOGETHER, 8):
        found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs, together=together).collect()}
        assert [found[i] for i in range(len(texts))] == want


def pages_of_one_template(seed, pairs):
    """Twice as many texts: those of a pair are linked; hardly any others, though all share the most of one template."""
    base, texts = prose(seed, 300), []
    for k in range(pairs):
        page = edited(base, 1000 * seed + 2 * k, 0.0135)
        texts += [page, edited(page, 1000 * seed + 2 * k + 1, 0.0201)]
    return texts


def test_large_buckets_lose_no_pair(spark):
    # In each of these templates, a pair's registers differ wherever buckets would be split by some of them.
    texts = [t for seed in (39, 49, 75, 76) for t in pages_of_one_template(seed, 15)]
    want = plain_classes(texts)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs, together=6).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_candidates_are_all_pairs_that_are_similar_enough(spark):
    r = random.Random(5)
    sets = []
    for _ in range(120):
        some = set(r.choice(sets)) if sets and r.random() < 0.8 else {r.randrange(-(2**63), 2**63) for _ in range(r.choice([1, 2, 5, 10, 40]))}
        sets.append({h for h in some if r.random() > 0.05} | {r.randrange(-(2**63), 2**63) for _ in range(r.randrange(3))} or some)
    # Labels with very many rows, and with one; from a label to itself nothing is asked for.
    labels = [0 if r.random() < 0.4 else 1 + i // 2 for i in range(len(sets))]
    rows = [(i, labels[i], bytearray(np.sort(np.array(list(s), np.int64).view(np.uint64)).tobytes())) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "row long, label long, shingle_set binary")
    for similarity in (0.5, 0.8):
        want = {
            (i, j)
            for i in range(len(sets))
            for j in range(i + 1, len(sets))
            if labels[i] != labels[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
        }
        assert len(want) > 50
        for cell in (1, 7, nd.CELL):
            found = [tuple(sorted(p)) for p in nd._candidates(table, similarity, cell).collect()]
            assert len(found) == len(set(found))
            assert want <= set(found) and all(labels[i] != labels[j] for i, j in found)


def test_awkward_rows(spark):
    found = nd.near_duplicates(documents(spark)).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
    assert len(found) == 12
    assert {r.class_id for r in by_doc[0] + by_doc[5]} == {0} and {r.class_size for r in by_doc[0] + by_doc[5]} == {3}
    assert sum(r.kept for r in by_doc[0] + by_doc[5]) == 1
    for d in (1, 2, 3, 4, 6, 7, 8, 9):
        assert [(r.class_id, r.class_size, r.kept) for r in by_doc[d]] == [(d, 1, True)]
    assert [(r.class_id, r.kept) for r in by_doc[None]] == [(None, True)]
    left = nd.without_near_duplicates(documents(spark))
    assert left.columns == documents(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 6, 7, None, 8, 9]))


def test_no_rows(spark):
    assert nd.near_duplicates(nothing(spark)).collect() == []
    assert nd.without_near_duplicates(nothing(spark)).collect() == []


def test_repeated_rows_alone(spark):
    docs = documents(spark, [(3, prose(9, 30), "en", "a")] * 4 + [(4, None, "en", "a")] * 2)
    assert sorted(r.doc_id for r in nd.without_near_duplicates(docs).collect()) == [3, 4, 4]


def test_how_often_passages_are_repeated_does_not_matter(spark):
    texts = []
    for k in range(12):
        words = prose(3000 + k, 200).split()
        # The same sets of shingles; a fifth, then half of them 64 times in one text.
        for share in (40, 100):
            block = words[:share]
            texts += [" ".join(block * 2 + words[share:]), " ".join(block * 64 + words[share:])]
        # A block of a seventh of the shingles, 64 times here and absent there.
        texts += [" ".join(words), " ".join(words + [f"more{k}x{i}" for i in range(28)] * 64)]
    want = plain_classes(texts)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert all(want[i] != i for i in range(1, len(texts), 2))


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (400, 100, 100))
    x, y = np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))
    wx, wy = np.ones(500), np.ones(500)
    held = [nd.sketch(np.zeros(500, np.int64), h, w, 1, 2048)[0] for h, w in ((x, wx), (y, wy))]
    assert abs((held[0] == held[1]).mean() - 400 / 600) < 0.05
    # Weights: sum over elements of 1 / sum_j max(x_j / x_i, y_j / y_i).
    ids = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wx, wy = r.random(40) + 0.1, r.random(40) + 0.1
    want = sum(1 / np.maximum(wx / wx[i], wy / wy[i]).sum() for i in range(40))
    held = [nd.sketch(np.zeros(40, np.int64), ids, w, 1, 4096)[0] for w in (wx, wy)]
    assert abs((held[0] == held[1]).mean() - want) < 0.05
    assert (nd.sketch(np.zeros(0, np.int64), ids[:0], wx[:0], 3) == 0).all()

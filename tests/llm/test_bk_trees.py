"""SimHash components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from shared import SF, TEXTS, documents, lower, nothing, table_rows, white_words

from fansieve.llm import bk_trees as B
from fansieve.llm import graph


def plain_fingerprint(text):
    words = white_words(lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The smallest place each is connected to, by all pairs."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def close_points(seed, n):
    """Clusters and chains of near fingerprints among random ones."""
    r = random.Random(seed)
    out = {0, 2**64 - 1, 1 << 63}
    while len(out) < n:
        p = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):
            out.add(p)
            for _ in range(r.choice([1, 2, 3, 4])):
                p ^= 1 << r.randrange(64)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_all_within_the_radius(seed):
    points = close_points(seed, 600)
    tree = B.Tree(points)
    assert len(tree.children) == len(points) - 1 == len(set(tree.children.tolist()))
    distance = np.bitwise_count(points[:, None] ^ points[None, :])
    for radius in (0, 2, 5):
        found = set(zip(*(c.tolist() for c in tree.within(points, radius)), strict=True))
        assert found == set(zip(*(c.tolist() for c in np.nonzero(distance <= radius)), strict=True))


def test_search_follows_few_edges():
    points = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64))
    tree, seen = B.Tree(points), []

    class Counting(np.ndarray):
        pass

    real = np.bitwise_count
    try:
        np.bitwise_count = lambda x: seen.append(len(x)) or real(x)
        tree.within(points[:200], 2)
    finally:
        np.bitwise_count = real
    assert sum(seen) < 0.1 * 200 * len(points)


def test_masks_share_bits():
    for masks, ways in zip(B._masks(3, 3), (3, 9, 27), strict=True):
        assert len(masks) == ways
    first, second, third = B._masks(3, 3)
    for k in range(27):
        assert (first[k // 9] | second[k // 3] | third[k]).bit_count() >= 44
        assert not first[k // 9] & second[k // 3] and not (first[k // 9] | second[k // 3]) & third[k]


@pytest.mark.parametrize(("average", "largest"), [(2048, 1 << 16), (20, 60), (5, 4)])
def test_links_connect_what_all_pairs_connect(spark, average, largest):
    points = close_points(9, 1500)
    # Many that share a block.
    r = random.Random(2)
    points = np.unique(np.concatenate([points, np.array([sum(1 << (3 * r.randrange(21) + 1) for _ in range(4)) for _ in range(300)], np.uint64)]))
    df = B.durable(spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long"))
    labels = {r["node"]: r["label"] for r in graph.components(B.links(df, average=average, largest=largest)).collect()}
    signed = [int(p) for p in points.view(np.int64)]
    want = plain_components([int(p) for p in points])
    groups = {}
    for p, w in zip(signed, want, strict=True):
        groups.setdefault(w, []).append(p)
    assert {p: labels.get(p, p) for p in signed} == {p: min(g) for g in groups.values() for p in g}


def check(spark, texts, df):
    """The result for ``(doc_id, text)`` rows, ids not null."""
    fps = [plain_fingerprint(t) for _, t in texts]
    labels = plain_components(fps)
    least = {}
    for (d, _), label in zip(texts, labels, strict=True):
        least[label] = min(d, least.get(label, d))
    want = sorted((d, f"{fp:016x}", least[label]) for (d, _), fp, label in zip(texts, fps, labels, strict=True))
    assert sorted(tuple(r) for r in df.collect()) == want
    return want


def test_query(spark):
    df = B.op11_simhash_components(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    want = check(spark, table_rows(spark, "documents", "doc_id, text"), df)
    assert len({c for _, _, c in want}) < len(want)


def test_awkward_rows(spark):
    texts = [t for t in TEXTS if t[0] is not None]
    df = B.similar_documents(documents(spark, texts))
    want = check(spark, [t[:2] for t in texts], df)
    assert [c for d, _, c in want if d in (1, 2, 3)] == [1, 1, 1]
    found = B.similar_documents(documents(spark, [(None, None, "en", "a"), (None, "", "en", "a"), (None, "x y z", "en", "b")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(None, None)} and len(found) == 3
    assert B.similar_documents(nothing(spark)).collect() == []


def test_parts_of_long_texts(monkeypatch):
    text = TEXTS[4][1] + "  \n Ä" + "Q" * 500
    whole = B.fingerprint(text.encode())
    for part in (1, 7, 1000):
        monkeypatch.setattr(B, "PART_BYTES", part)
        assert B.fingerprint(text.encode()) == whole == plain_fingerprint(text)
        assert B.fingerprint(b"One  two ") == plain_fingerprint("one two")


def test_frequent_keys_are_joined_alike(spark, monkeypatch):
    monkeypatch.setattr("fansieve.operators.graph.FREQUENT_ROWS", 3)
    edges = [(k, k % 7) for k in range(7, 400)] + [(1000 + k, 1001 + k) for k in range(30)] + [(3, 1000)]
    labels = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: k % 7 for k in range(400)} | {1000 + k: 3 for k in range(31)}
    assert labels == want

import math

import numpy as np
from pyspark.sql import functions as F
from shared import SF, SF_2, table_rows

from fansieve.llm import neighbours as nb

KIND = "vec_id long, embedding array<float>, label int, rank int, score double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 0.0) for i, v in vectors], KIND)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / math.sqrt((a * a).sum()) / math.sqrt((b * b).sum()))


def plain(vectors, queries, most=5):
    out = {}
    for q in queries:
        v = dict(vectors)[q]
        best = sorted(((-cosine(v, x), i) for i, x in vectors if i != q))[:most]
        out[q] = [(i, -s) for s, i in best]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_of_the_query(spark):
    for sf in (SF, SF_2):
        vectors = [(i, v) for i, v in table_rows(spark, "embeddings", "vec_id, embedding", sf)]
        want = plain(vectors, [i for i, _ in vectors if i % 50 == 0])
        got = results(nb.op9_neighbours(spark, sf))
        assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
        by_id = dict(vectors)
        for q, found in got.items():
            assert all(abs(s - cosine(by_id[q], by_id[i])) < 1e-12 for i, s in found)
            assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 5 * len(want)


def test_slices_and_blocks_do_not_change_the_answers(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where(F.col("vec_id") % 10 == 0)
    assert results(nb.search(vectors, queries)) == results(nb.search(vectors, queries, slice_size=60, block=7))


def test_awkward_vectors(spark):
    r = np.random.default_rng(2)
    same = r.standard_normal(8).astype(np.float32).tolist()
    vectors = [(k, same) for k in range(20, 220)]  # a large group of copies
    vectors += [(k, (np.array(same) + 0.3 * r.standard_normal(8)).astype(np.float32).tolist()) for k in range(300, 310)]
    bad = [(1, None), (2, []), (3, [0.0] * 8), (4, [math.nan] * 8), (5, [math.inf, *[1.0] * 7]), (6, [None, *[1.0] * 7]), (None, same), (7, [1.0, 2.0])]
    df = frame(spark, vectors + bad + vectors[:3])
    asked = [20, 25, 26, 150, 300]
    got = results(nb.search(df, df.where(F.col("vec_id").isin(*asked, 1, 2, 3, 4, 5, 6, 7))))
    want = plain(vectors, asked)
    assert set(got) == set(asked)
    for q in asked:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert nb.search(df.limit(0), df.limit(0)).collect() == [] and nb.search(frame(spark, bad), frame(spark, bad)).collect() == []
    assert results(nb.search(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0])]), frame(spark, [(1, [1.0, 0.0])]))) in ({}, {1: [(2, 0.0)]})


def test_every_query_has_its_full_answer(spark):
    assert results(nb.search(frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0])]), frame(spark, [(1, [1.0, 0.0])]))) == {1: [(2, 0.0)]}
    r = np.random.default_rng(4)
    # A group of three on the other side of 60 vectors close to each other, and one far from both.
    center = r.standard_normal(64)
    vectors = [(k, (center + 0.01 * r.standard_normal(64)).tolist()) for k in range(60)]
    vectors += [(100 + k, (0.01 * r.standard_normal(64) - center).tolist()) for k in range(3)] + [(200, r.standard_normal(64).tolist())]
    vectors = [(i, [float(x) for x in np.float32(v)]) for i, v in vectors]
    df, asked = frame(spark, vectors), [100, 101, 102, 200, 0]
    for slice_size in (nb.SLICE, 20):
        got = results(nb.search(df, df.where(F.col("vec_id").isin(*asked)), slice_size=slice_size))
        want = plain(vectors, asked)
        assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_large_and_small_numbers():
    x = np.array([[1e-30, 2e-30], [3e300, 1e300], [1e-300, 0.0]])
    assert np.allclose(np.linalg.norm(nb.units(x), axis=1), 1)
    assert np.allclose(nb.cosines(x[1], x), [(3 + 2) / math.sqrt(50), 1, 3 / math.sqrt(10)])


def test_perturbations_come_in_the_order_of_their_expected_cost():
    m = 3
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 7)]
    sets = nb.perturbations(m, 1000)
    assert len(sets) == 27 and len({tuple(s) for s in sets}) == 27  # down, up or neither for each number
    costs = (sets * np.array(z)).sum(axis=1)
    assert (np.diff(costs) >= -1e-12).all() and costs[0] == 0

"""Nearest neighbours by cosine with multiprobe p-stable hashing.

A table hashes a vector of length 1 by ``HASHES`` numbers floor((a . v + b) / width), a normally distributed, which near vectors share often. A
query visits its own bucket in every table, then the buckets that differ by one step up or down in some of the numbers, in the
order of the estimated chance that a near vector fell there: near the query's own borders first. The members of all visited buckets
are candidates, and candidates are ranked by their exact cosine. A query that finds fewer than asked for, though there are more vectors of its
length (an outlier, a member of a small group, a small table), is answered once more, by the exact cosines of all of them.

Equal vectors are searched and indexed once, with as many of their ids as a result can need; so copies, however many, fill no bucket. The
index is dealt into slices of about ``SLICE`` vectors and the queries into blocks; each slice is hashed in the task that holds it and
answers a block of queries with its nearest ones, and the slices' answers are merged. The tables are the same in all slices. All vectors are indexed.

Cases: vectors that are null, zero, or hold a null or a number that is not finite take no part, as queries and as candidates; vectors
of different lengths are not compared; a null id takes no part; rows with the same id and vector count once; other columns are
never read; an empty table gives an empty result. The measured recall of the five nearest is in the README.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansieve.session import durable, table

TABLES, HASHES, WIDTH, PROBES = 18, 12, 2.0, 1000
SLICE, BLOCK = 16_384, 4096
NEAREST = 5


def perturbations(hashes: int, probes: int) -> np.ndarray:
    """[probe, rank]: which of the 2 * hashes borders, nearest first, a probe crosses; probes in the order of expected success.

    The expected squared distance to the border of rank j has a closed form for uniformly distributed places in a bucket; the
    sets with the least sums are found with a heap. No probe crosses both borders of one number.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = 2 * m + 1 - j
    cost = np.where(j <= m, low, 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    sets, heap = [()], [(cost[0], (0,))]
    while heap and len(sets) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - c in chosen for c in chosen):
            sets.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(sets), 2 * m), np.int64)
    for i, chosen in enumerate(sets):
        out[i, list(chosen)] = 1
    return out


class Tables:
    """Hash functions for vectors of one length, the same wherever they are made."""

    def __init__(self, length: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = 11):
        r = np.random.default_rng([seed, length])
        self.a = r.standard_normal((tables, length, hashes)) / width
        self.b = r.random((tables, hashes))
        self.times = r.integers(1, 1 << 62, (tables, hashes))
        self.crossed = perturbations(hashes, probes)

    def keys(self, t: int, unit: np.ndarray) -> np.ndarray:
        return (np.floor(unit @ self.a[t] + self.b[t]).astype(np.int64) * self.times[t]).sum(axis=1)

    def probes(self, t: int, unit: np.ndarray) -> np.ndarray:
        """[query, probe]: the keys of the buckets to visit."""
        at = unit @ self.a[t] + self.b[t]
        own = np.floor(at)
        inside = at - own
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1)
        change = np.concatenate([-self.times[t], self.times[t]])[order]
        return (own.astype(np.int64) * self.times[t]).sum(axis=1)[:, None] + change @ self.crossed.T


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosines of one vector with others, summed in the same order for each."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * math.sqrt(np.einsum("i,i->", q, q)))


def nearest(index: np.ndarray, ids: list[list[int]], queries: np.ndarray, most: int, tables: Tables | None) -> list[list[tuple[float, int]]]:
    """For each query the ``most`` best (score, id) among its candidates in the index, without ``tables`` among all of it; each vector of the
    index has some ids."""
    found = np.zeros((len(queries), len(index)), bool)
    unit, asked = units(index), units(queries)
    if tables is None:
        for begin in range(0, len(queries), 256):
            about = asked[begin : begin + 256] @ unit.T
            limit = np.partition(about, -min(most, len(index)), axis=1)[:, -min(most, len(index))]
            # The last digits of a product may differ from those of ``cosines``.
            found[begin : begin + 256] = about >= limit[:, None] - 1e-9
    for t in range(len(tables.a) if tables else 0):
        key = tables.keys(t, unit)
        order = np.argsort(key, kind="stable")
        key = key[order]
        for begin in range(0, len(queries), 256):
            visit = tables.probes(t, asked[begin : begin + 256])
            low, high = np.searchsorted(key, visit), np.searchsorted(key, visit, side="right")
            query, probe = np.nonzero(high > low)
            low, times = low[query, probe], (high - low)[query, probe]
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            found[begin + np.repeat(query, times), order[at]] = True
    out = []
    for k in range(len(queries)):
        candidates = np.flatnonzero(found[k])
        score = cosines(queries[k], index[candidates])
        if len(score) > most:
            limit = np.partition(score, len(score) - most)[len(score) - most]
            some = score >= limit
            candidates, score = candidates[some], score[some]
        pairs = sorted((-s, i) for s, c in zip(score.tolist(), candidates.tolist(), strict=True) for i in ids[c])
        out.append([(-s, i) for s, i in pairs[:most]])
    return out


def _distinct(vectors: DataFrame, most: int) -> DataFrame:
    """``(vector, ids)`` of the distinct valid vectors, as bytes of doubles, with their ``most`` smallest ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or v is None or len(v) == 0 or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64) + 0.0  # no negative zero
                if np.isfinite(x).all() and x.any():
                    held.setdefault(x.tobytes(), []).append(i)
            ids = [sorted(set(i))[:most] for i in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["vector", "ids"])

    parts = vectors.select("vec_id", "embedding").mapInArrow(task, "vector binary, ids array<long>")
    # A task has sent at most ``most`` ids of a vector from each batch.
    return parts.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def _one_by_one(vectors: DataFrame) -> DataFrame:
    """``(vector, vec_id)`` of the valid vectors, as bytes of doubles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is not None and v is not None and len(v) and not any(x is None for x in v):
                    x = np.array(v, np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        out.append((x.tobytes(), i))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.binary()), pa.array([i for _, i in out], pa.int64())], names=["vector", "vec_id"])

    return vectors.select("vec_id", "embedding").mapInArrow(task, "vector binary, vec_id long")


def _answers(index: DataFrame, kinds: DataFrame, keep: int, slices: int, block: int, exact: bool) -> DataFrame:
    """``(query, best)`` of those ``kinds(vector, query, length)`` that have candidates: the ``keep`` best as (place, vec_id, score)."""
    blocks = max(1, math.ceil(kinds.count() / block))
    slice_of, block_of = F.pmod(F.xxhash64("vector"), F.lit(slices)), F.pmod(F.xxhash64(F.lit(1), F.col("vector")), F.lit(blocks))
    left = index.withColumns({"slice": slice_of, "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    right = kinds.withColumns({"block": block_of, "slice": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))})

    def group(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if index.num_rows and queries.num_rows:
            length = index.column("length")[0].as_py()
            x, q = (np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, length) for t in (index, queries))
            answers = nearest(x, index.column("ids").to_pylist(), q, keep, None if exact else Tables(length))
            for number, answer in zip(queries.column("query").to_pylist(), answers, strict=True):
                out.extend((number, i, s) for s, i in answer)
        return pa.table({"query": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    keys = ("length", "slice", "block")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(group, "query long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = parts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))


def search(vectors: DataFrame, queries: DataFrame, most: int = NEAREST, slice_size: int = SLICE, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each of ``queries`` the ``most`` nearest of ``vectors``, its own row left out.

    Both are ``(vec_id, embedding)``. One id more than asked for is kept, as one may be the query's own.
    """
    keep = most + 1
    # Vectors of one length meet only each other.
    index = durable(_distinct(vectors, keep).withColumn("length", (F.octet_length("vector") / 8).cast("int")))
    asked = durable(_one_by_one(queries).distinct())
    kinds = durable(asked.select("vector").distinct().withColumns({"query": F.monotonically_increasing_id(), "length": (F.octet_length("vector") / 8).cast("int")}))
    slices = max(1, math.ceil(index.count() / slice_size))
    best = durable(_answers(index, kinds, keep, slices, block, exact=False))
    there = index.groupBy("length").agg(F.sum(F.size("ids")).alias("there"))
    found = kinds.join(best.select("query", F.size("best").alias("found")), "query", "left").join(F.broadcast(there), "length")
    short = durable(found.where(F.coalesce("found", F.lit(0)) < F.least(F.col("there"), F.lit(keep))).select("vector", "query", "length"))
    if short.head(1):
        best = durable(best.join(short.select("query"), "query", "left_anti").unionByName(_answers(index, short, keep, slices, block, exact=True)))
    # Every query row: the answer of its vector without itself.
    answers = asked.withColumnRenamed("vec_id", "query_id").join(kinds.select("vector", "query"), "vector").join(best, "query")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, most)
    out = answers.select("query_id", F.posexplode(others).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def queries():
    return {"op9_neighbours": op9_neighbours}

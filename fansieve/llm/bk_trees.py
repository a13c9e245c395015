"""Near-duplicate documents by SimHash fingerprints, whose neighbours BK-trees find.

A text's shingles are its runs of three words in lower case, repeats included (a shorter text has one, of all its words). A bit of the 64 of its
fingerprint is set if it is set in over half of the shingles' XXH64 hashes. Fingerprints that differ in ``RADIUS`` bits or less are linked;
components are what links connect.

1. Distinct fingerprints are dealt to shards: 64 bits cut into ``RADIUS`` + 1 blocks leave at least one block equal in every linked pair, so each fingerprint
   goes to one shard by each of its blocks, and no link is lost between shards. A shard holds some thousands at every size of input.
2. Shards that a common block value makes too large are dealt again by that whole value, then by blocks of the bits that are still free, twice over.
   Members of a shard then share 44 bits at least, so that it cannot hold more than 2**20.
3. A shard's fingerprints form a BK-tree: a child hangs under its parent by their integer distance. A search at distance d from a node follows only the
   edges d - ``RADIUS`` to d + ``RADIUS``. All members are searched, some thousand at a time, and only links that join something leave the shard.
4. Components are found over fingerprints, and each takes its smallest doc_id.

The shard trees meet their searches by a shuffle. They are not broadcast: that would carry the fingerprints of all documents through the driver and,
with a thousand times the rows, send each of a thousand times as many trees to every task.

Cases: null, empty and white texts have no words, so the fingerprint zero, and are linked like others; bytes 0x20 and 0x09-0x0D separate words; long texts are
hashed in parts; rows that are repeated or share a doc_id are rows of their own; a component of null ids has a null id; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.llm.arrow import buffers, rows, strings
from fansieve.llm.graph import components, uneven_join
from fansieve.session import durable, table

SIZE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a shard, on average and at most before it is dealt again.
SHARD, LARGEST = 2048, 1 << 16
#: Bytes of a text that are hashed together, and members that are searched together.
PART_BYTES, TOGETHER = 1 << 20, 4096

_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A text's words in lower case, about a megabyte of text at a time."""
    begin = 0
    while begin < len(text):
        found = _WHITE.search(text, min(begin + PART_BYTES, len(text)))
        end = found.end() if found else len(text)
        yield text[begin:end].lower().split()
        begin = end


def shingle_hashes(text: bytes, size: int = SIZE) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's shingles, in parts."""
    held: list[bytes] = []
    any_yet = False
    for words in _words(text):
        held += words
        if len(held) >= size:
            joined = memoryview(b" ".join(held))
            ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
            begins = np.concatenate([[0], ends[:-size]]).tolist()
            digest, seed = xxhash.xxh64_intdigest, SEED
            n = len(begins)
            yield np.fromiter((digest(joined[i:j], seed) for i, j in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
            held, any_yet = held[len(held) - size + 1 :], True
    if held and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set, the lowest first."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    # Sums of up to 255 bits fit a byte.
    parts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
    return parts.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)


def fingerprint(text: bytes, size: int = SIZE) -> np.uint64:
    n, counts = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size):
        n, counts = n + len(h), counts + _bit_counts(h)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, fp)``, the 64 bits as a long, of each row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            raw, at = buffers(strings(batch.column("text")))
            found = np.array([fingerprint(raw[i:j].tobytes(), size) for i, j in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield rows(pa.schema([("doc_id", ids.type), ("fp", pa.int64())]), doc_id=ids, fp=found.view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, fp long")


class Tree:
    """A BK-tree of distinct fingerprints; the first is the root."""

    def __init__(self, points: np.ndarray):
        self.points, n = points, len(points)
        self.slots, self.children = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, slot = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        parent = np.zeros(len(waiting), np.int64)
        slots, children = [], []
        while len(waiting):
            # Under each parent, points of equal distance: the first of them becomes the child, the others go below it.
            slot = parent * 65 + np.bitwise_count(points[waiting] ^ points[parent])
            held, first, of = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(held)
            children.append(waiting[first])
            parent = waiting[first][of]
            below = parent != waiting
            waiting, parent = waiting[below], parent[below]
        if slots:
            order = np.argsort(np.concatenate(slots))
            self.slots, self.children = np.concatenate(slots)[order], np.concatenate(children)[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point), by their places, of all pairs that differ in at most ``radius`` bits."""
        query = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        found = []
        while len(query) and len(self.points):
            distance = np.bitwise_count(queries[query] ^ self.points[node]).astype(np.int64)
            near = distance <= radius
            found.append((query[near], node[near]))
            low, high = np.maximum(distance - radius, 0), np.minimum(distance + radius, 64)
            begin, end = np.searchsorted(self.slots, node * 65 + low), np.searchsorted(self.slots, node * 65 + high, side="right")
            n = end - begin
            query = np.repeat(query, n)
            node = self.children[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (smallest places) after linking a with b."""
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(new, label[side], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        new = new[label]
        if np.array_equal(new[a], new[b]):
            return new
        label = new


def shard_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct points in ascending order, those linked to a smaller one, and the smallest that each is connected to."""
    tree, label = Tree(points), np.arange(len(points))
    for begin in range(0, len(points), TOGETHER):
        query, node = tree.within(points[begin : begin + TOGETHER], radius)
        label = _joined(label, query + begin, node)
    joined = label != np.arange(len(points))
    return points[joined], points[label[joined]]


def _masks(levels: int, parts: int) -> list[list[int]]:
    """By level, the blocks that pigeonholing takes next, for every way here: first of all bits, then of those left free."""
    ways, out = [list(range(64))], []
    for _ in range(levels):
        blocks = [[free[k::parts] for k in range(parts)] for free in ways]
        out.append([sum(1 << bit for bit in block) for some in blocks for block in some])
        ways = [[bit for bit in free if bit not in block] for free, some in zip(ways, blocks, strict=True) for block in some]
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block(masks: list[int], way: Column) -> Column:
    return F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), way + 1))


def shards(distinct: DataFrame, radius: int = RADIUS, average: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """``(shard, fp)``: every two of ``distinct(fp)``, stored, within the radius share a shard."""
    parts = radius + 1
    masks = _masks(3, parts)
    # Shards of many block values each: so many that they have some thousand members at every size.
    number = max(1, -(-distinct.count() // average))
    ways = F.explode(F.array(*[F.lit(k) for k in range(parts)]))
    members = distinct.select("fp", ways.alias("way"))
    members = members.select("fp", "way", F.struct("way", F.pmod(F.xxhash64(_block(masks[0], F.col("way"))), F.lit(number)).alias("of")).alias("key"))
    members = members.select("fp", "way", F.xxhash64("key").alias("shard"))
    done = []
    for level in range(len(masks) + 1):
        members = durable(members)
        large = durable(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("shard"))
        if level == len(masks) or not large.head(1):
            return _union([*done, members.select("shard", "fp")])
        # Not more than a large shard's share of all members: a bounded part of the shards.
        done.append(members.join(large, "shard", "left_anti").select("shard", "fp"))
        members = members.join(large, "shard", "left_semi")
        if level:
            members = members.select("fp", "shard", (F.col("way") * parts).alias("first"), ways.alias("k")).select("fp", "shard", (F.col("first") + F.col("k")).alias("way"))
        members = members.select("fp", "way", F.xxhash64("shard", F.lit(level), "way", _block(masks[level], F.col("way"))).alias("shard"))
    raise AssertionError


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def links(distinct: DataFrame, radius: int = RADIUS, average: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """``(a, b)``: links between fingerprints of ``distinct(fp)``, stored, that connect all that is within the radius."""

    def group(held: pa.Table) -> pa.Table:
        points = np.unique(held.column("fp").to_numpy())
        a, b = shard_links(points.view(np.uint64), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return shards(distinct, radius, average, largest).groupBy("shard").applyInArrow(group, "a long, b long")


def similar_documents(docs: DataFrame, size: int = SIZE, radius: int = RADIUS, average: int = SHARD, largest: int = LARGEST) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    of_rows = durable(fingerprints(docs, size))
    distinct = durable(of_rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = durable(links(distinct.select("fp"), radius, average, largest).distinct())
    labels = components(found)
    labelled = durable(distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = labelled.groupBy(F.col("label").alias("its_label")).agg(F.min("least").alias("component_id"))
    of_fps = durable(uneven_join(labelled.select("fp", "label"), least, "label", "its_label").select(F.col("fp").alias("its_fp"), "component_id"))
    out = uneven_join(of_rows, of_fps, "fp", "its_fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def queries():
    return {"op11_simhash_components": op11_simhash_components}

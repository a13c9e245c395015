"""Fingerprints of whole texts by a randomised edit embedding.

Every text takes the same random walk: at time t it shows the character at which it stands, and a random bit of (t, character), the same for
all texts, says whether it goes on to the next one. Texts that differ by few edits soon show the same characters at the same times again,
so their edit distance becomes a Hamming distance of what they show. A fingerprint holds a sample of the times: a time has level
k with probability 2**-k, and a text has all times of the lowest level at which these are about ``TIMES`` or fewer. Samples of
different levels are nested, so fingerprints of texts of any two lengths can be compared: ``likeness`` is the share of common times,
out of those of the longer walk, at which both show the same.

``near_texts`` finds texts with like fingerprints: bands of sampled bits put them into buckets, each bucket is compared with
its most central text, and what is as like as ``LIKE`` is linked.

Cases: a null text is an empty one; the fingerprint of an empty text has no times, and is like another such and nothing else; the next
document is the one with the next doc_id, null first; rows with the same doc_id are ordered by text; after the last one comes the
first, which is the last itself in a table of one row; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansieve.llm.arrow import buffers, mix, rows, slices, strings
from fansieve.llm.graph import components
from fansieve.llm.near_duplicates import central_pairs
from fansieve.session import durable, table

TIMES = 256
#: Kinds of characters; the walk's bits repeat after so many times.
KINDS, PERIOD = 64, 1 << 16
#: With fewer texts still walking, each is walked alone.
FEW = 64
#: Bytes of text that walk together; characters of a text that walks alone, or times, that are looked at in one piece.
SLICE, PIECE = 6 << 20, 1 << 20
#: Bands, sampled times in each, and the first so many times from which they are drawn; least likeness of near texts.
BANDS, IN_BAND, AMONG, LIKE = 24, 8, 96, 0.8

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _steps() -> np.ndarray:
    """[kind, time]: how long a walk that comes to a character of this kind at this time stays there."""
    bits = mix(np.arange(KINDS * PERIOD, dtype=np.uint64) + np.uint64(0xED17)).reshape(KINDS, PERIOD) & np.uint64(1)
    stay = np.zeros((KINDS, PERIOD), np.uint8)
    ahead = np.full(KINDS, 60, np.uint8)
    for _ in range(2):  # twice, as after the last time comes the first
        for t in range(PERIOD - 1, -1, -1):
            ahead = np.where(bits[:, t] == 1, 1, np.minimum(ahead + 1, 60)).astype(np.uint8)
            stay[:, t] = ahead
    return stay


class Walks:
    """The walk's table, and the times of each level."""

    def __init__(self):
        self.stay = _steps()
        self.flat = self.stay.ravel()
        self.alone = [row.tobytes() for row in self.stay]
        self.level = np.zeros(0, np.uint8)
        self.times: dict[int, np.ndarray] = {}

    def prepare(self, longest: int) -> None:
        """Have the levels of all times up to ``longest``."""
        if longest > len(self.level):
            parts, end = [self.level], max(longest, min(2 * len(self.level), len(self.level) + PIECE))
            for begin in range(len(self.level), end, PIECE):
                h = mix(np.arange(begin, min(begin + PIECE, end), dtype=np.uint64) + np.uint64(0x71E5))
                lowest = h & (~h + np.uint64(1))
                parts.append(np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.uint8))
            self.level = np.concatenate(parts)
            self.times = {}

    def of_level(self, k: int) -> np.ndarray:
        if k not in self.times:
            self.times[k] = np.flatnonzero(self.level >= k)
        return self.times[k]

    def walk(self, kinds: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """When each character is come to, and when each text ends; text i is ``kinds[first[i]:first[i] + size[i]]``."""
        # A character is left after 60 times at most.
        begin = np.zeros(len(kinds), np.int32 if len(kinds) <= np.iinfo(np.int32).max // 64 else np.int64)
        end = np.zeros(len(first), np.int64)
        order = np.argsort(-size, kind="stable")
        at, left = first[order].copy(), size[order]
        now = np.zeros(len(order), np.int64)
        n, t = len(order), 0
        alone = int(left[FEW]) if len(left) > FEW else 0  # up to here more than FEW texts walk
        going = np.searchsorted(-left, -np.arange(alone), side="left")
        while t < alone:
            if going[t] < n:
                n = int(going[t])
                at, now = self._stop(end, order, at, now, n)
            begin[at] = now
            now += self.flat[kinds[at].astype(np.int64) * PERIOD + (now & (PERIOD - 1))]
            at += 1
            t += 1
        n = int(np.searchsorted(-left, -t, side="left"))
        at, now = self._stop(end, order, at, now, n)
        for k in range(n):
            i, clock, stay = order[k], int(now[k]), self.alone
            place = int(at[k])
            last = int(first[i] + size[i])
            while place < last:
                came = []
                for c in kinds[place : min(place + PIECE, last)].tobytes():
                    came.append(clock)
                    clock += stay[c][clock & 65535]
                begin[place : place + len(came)] = came
                place += len(came)
            end[i] = clock
        return begin, end

    @staticmethod
    def _stop(end, order, at, now, n):
        end[order[n : len(now)]] = now[n:]
        return at[:n].copy(), now[:n].copy()

    def fingerprints(self, kinds: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Of each text the level of its times, and what it shows at them, in 4 bits each."""
        begin, end = self.walk(kinds, first, size)
        self.prepare(int(end.max(initial=0)))
        shows = (mix(np.arange(KINDS, dtype=np.uint64) + np.uint64(0x5A)) & np.uint64(15)).astype(np.uint8)
        out = []
        for f, n, e in zip(first.tolist(), size.tolist(), end.tolist(), strict=True):
            level = max(0, int(np.ceil(np.log2(max(1, e) / TIMES))))
            times = self.of_level(level)
            times = times[: np.searchsorted(times, e)]
            out.append((level, shows[kinds[f + np.searchsorted(begin[f : f + n], times, side="right") - 1]] if n else np.zeros(0, np.uint8)))
        return out

    def likeness(self, a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
        if a[0] > b[0]:
            a, b = b, a
        (low, x), (high, y) = a, b
        if low < high:
            x = x[self.level[self.of_level(low)[: len(x)]] >= high]
        longer, common = max(len(x), len(y)), min(len(x), len(y))
        return float((x[:common] == y[:common]).sum() / longer) if longer else 1.0


def written(fingerprint: tuple[int, np.ndarray]) -> str:
    return f"{fingerprint[0]}." + _HEX[fingerprint[1]].tobytes().decode()


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    level, _, shown = fingerprint.partition(".")
    return int(level), np.array([int(c, 16) for c in shown], np.uint8)


_WALKS: list[Walks] = []


def walks() -> Walks:
    """One table per worker."""
    if not _WALKS:
        _WALKS.append(Walks())
    return _WALKS[0]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of every code point of all texts, where each text's begin (one more entry for the end), and each code point's place in the bytes."""
    raw, at = buffers(texts)
    places = np.flatnonzero((raw & 0xC0) != 0x80)
    value = raw[places].astype(np.uint64)
    padded = np.append(raw, np.zeros(3, np.uint8))
    length = np.diff(np.append(places, len(raw)))
    for k in range(1, 4):
        more = length > k
        value[more] = value[more] * np.uint64(257) + padded[places[more] + k]
    kinds = (mix(value) % np.uint64(KINDS)).astype(np.uint8)
    return kinds, np.searchsorted(places, at), np.append(places, len(raw))


class _Edited:
    """Fingerprints of consecutive documents and of each with its end replaced by the beginning of the next."""

    def __init__(self, texts: pa.Array):
        """The last text is only the next one of the one before it."""
        w = walks()
        kinds, first, places = characters(texts)
        size = np.diff(first)
        self.n_chars = size[:-1]
        half = size[:-1] // 2
        keep, take = size[:-1] - half, np.minimum(half, size[1:])
        own = w.fingerprints(kinds, first[:-1], size)
        total = keep + take
        begin = np.cumsum(total) - total
        parts = [kinds[a : a + n] for a, b, k, t in zip(first[:-2].tolist(), first[1:-1].tolist(), keep.tolist(), take.tolist(), strict=True) for a, n in ((a, k), (b, t))]
        edited = w.fingerprints(np.concatenate([kinds[:0], *parts]), begin, total)
        raw, _ = buffers(texts)
        self.sha, data = [], raw.tobytes()
        ends = (places[first[:-1]], places[first[:-1][: len(keep)] + keep], places[first[1:-1]], places[first[1:-1] + take])
        for a, b, c, d in zip(ends[0][: len(keep)].tolist(), *(e.tolist() for e in ends[1:]), strict=True):
            self.sha.append(hashlib.sha256(data[a:b] + data[c:d]).hexdigest())
        self.fingerprint, self.edited = [written(f) for f in own[:-1]], [written(f) for f in edited]
        self.near_edited = [w.likeness(a, b) for a, b in zip(own[:-1], edited, strict=True)]
        self.near_next = [w.likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]

    def columns(self) -> dict:
        return {
            "n_chars": self.n_chars, "edited_sha256": self.sha, "fingerprint": self.fingerprint, "edited_fingerprint": self.edited,
            "near_edited": self.near_edited, "near_next": self.near_next,
        }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result_fields() -> list:
    return [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def fingerprints_in_order(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, as in op2.

    The texts are shuffled once, into ranges of doc_id. What a range's last document needs of the next range, its first text, is met in
    a join of as many rows as there are ranges.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, waiting, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id"), strings(batch.column("text"))
            head = texts.slice(0, 1) if waiting is None else head
            if waiting is not None:
                ids, texts = pa.concat_arrays([waiting[0], ids]), pa.concat_arrays([waiting[1], texts])
            schema = pa.schema([("part", pa.int64()), ("doc_id", ids.type), *_result_fields(), ("head", pa.string()), ("tail", pa.string())])
            with_next = len(texts) - 1
            for begin, some in slices(texts.slice(0, with_next), SLICE):
                n = len(some)
                made = _Edited(texts.slice(begin, n + 1)).columns()
                none = pa.nulls(n, pa.string())
                yield rows(schema, part=np.full(n, part), doc_id=ids.slice(begin, n), **made, head=none, tail=none)
            # The last one waits for the next, in memory of its own.
            waiting = (pa.array(ids.slice(with_next, 1).to_pylist(), ids.type), pa.array(texts.slice(with_next, 1).to_pylist(), texts.type))
            head = pa.array(head.to_pylist(), head.type)
        if waiting is not None:
            nothing = {name: pa.nulls(1, kind) for name, kind in _result_fields()}
            yield rows(schema, part=[part], doc_id=waiting[0], **nothing, head=head, tail=waiting[1])

    found = durable(ordered.mapInArrow(task, f"part long, doc_id {id_type}, {_RESULT}, head string, tail string"))
    last = found.where(F.col("tail").isNotNull())
    # As many rows as ranges; the texts come by joins.
    everywhere = Window.orderBy("part")
    after = last.select("part", F.lead("part").over(everywhere).alias("after"), F.min("part").over(Window.partitionBy()).alias("least"))
    after = after.select("part", F.coalesce("after", "least").alias("after"))
    heads = last.select(F.col("part").alias("after"), F.col("head").alias("next_text"))
    pairs = last.select("part", "doc_id", "tail").join(after, "part").join(heads, "after").select("doc_id", F.col("tail").alias("text"), "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            schema = pa.schema([("doc_id", ids.type), *_result_fields()])
            for k in range(batch.num_rows):
                both = pa.concat_arrays([strings(batch.column(c).slice(k, 1)) for c in ("text", "next_text")])
                yield rows(schema, doc_id=ids.slice(k, 1), **_Edited(both).columns())

    kind = f"doc_id {id_type}, {_RESULT}"
    return found.where(F.col("tail").isNull()).drop("part", "head", "tail").unionByName(pairs.mapInArrow(close, kind))


def near_texts(fingerprints: DataFrame, like: float = LIKE) -> DataFrame:
    """``(row, class_row)`` of ``fingerprints(row, fingerprint)``, row a unique long: the smallest row of those with like fingerprints.

    Bands are drawn from the first ``AMONG`` times of a text's level, and of the next one where it has as many: so texts whose lengths
    fall on either side of a level's limit share the higher one. Equal fingerprints are compared once.
    """
    stands = durable(fingerprints.groupBy("fingerprint").agg(F.min("row").alias("stands")))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = walks()
        drawn = mix(np.arange(BANDS * IN_BAND, dtype=np.uint64) + np.uint64(0xBA7D)).reshape(BANDS, IN_BAND) % np.uint64(AMONG)
        drawn = drawn.astype(np.int64)
        for batch in batches:
            row, out = [], []
            for r, text in zip(batch.column("stands").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                level, shown = read(text)
                w.prepare(TIMES << (level + 1))
                times = w.of_level(level)[: len(shown)]
                finer = shown[w.level[times] > level]
                for k, x in ((level, shown), (level + 1, finer)):
                    if len(x) and (k == level or len(x) >= AMONG):
                        held = np.append(x, np.full(max(0, AMONG - len(x)), 16, np.uint8))[drawn].astype(np.uint64)
                        key = np.arange(BANDS, dtype=np.uint64) * np.uint64(64) + np.uint64(k)
                        for c in range(IN_BAND):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + held[:, c])
                        out.append(key.view(np.int64))
                        row.append(np.full(BANDS, r))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *out])), pa.array(np.concatenate([none, *row]))], names=["bucket", "row"])

    members = durable(stands.select("stands", "fingerprint").mapInArrow(buckets, "bucket long, row long"))
    pairs = central_pairs(members)
    both = pairs.join(stands.toDF("a_print", "a"), "a").join(stands.toDF("b_print", "b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = walks()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_print").to_pylist(), batch.column("b_print").to_pylist(), strict=True):
                x, y = read(x), read(y)
                w.prepare(TIMES << (max(x[0], y[0]) + 1))
                keep.append(w.likeness(x, y) >= like)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    labels = components(both.select("a", "b", "a_print", "b_print").mapInArrow(verify, "a long, b long"))
    out = fingerprints.select("row", "fingerprint").join(stands, "fingerprint").join(labels, F.col("stands") == F.col("node"), "left")
    return out.select("row", F.coalesce("label", "stands").alias("class_row"))


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_in_order(table(spark, sf_dir, "documents"))


def queries():
    return {"op2_edit_fingerprints": op2_edit_fingerprints}

"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, by merging their ends in equal-work pieces.

Both tokenizers read a text with a space before it: A, byte-level, gets that space; B, sentencepiece, adds it. Every token covers some bytes,
so the ends of a text's tokens are two ascending lists. Merging them gives, for every stretch between neighbouring ends, the one token of A and the one of B
that overlap there; where both end, a group of tokens ends.

1. A text is cut before single spaces between two visible characters. No token of either crosses such a place: pieces of B have spaces only in front, and A's
   words begin with them. So what stands between is tokenised once, however often it occurs, and long texts are read in parts.
2. Merge path: the ends of all texts of a slice lie on one grid. A binary search on each of its evenly spaced diagonals, all at once, finds where the
   merging passes, so that it falls into pieces of equal work that are independent of each other. Equal ends are kept in one piece.
3. A piece emits overlaps, and which of them end together. The group that a piece's border cuts is stitched from the pieces on its two sides.
4. A pair of ids counts as often as it ends together in all documents. Each document sends its distinct pairs with their numbers; the most frequent pairs, at
   most ``HEAD``, go to all tasks, the others meet their documents in a join, where none of them is frequent.

Cases: a text that is null, empty, or not given back byte by byte by both tokenizers has no tokens; special tokens in a text are plain text; a stretch without any place
to cut is tokenised whole; rows that are repeated or share a doc_id are rows of their own and count each time; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansieve.llm.arrow import Words, buffers, distinct, rows, slices, split_at, strings
from fansieve.session import durable, table

#: Ends of tokens in a piece; bytes of a text that are read together; stretches of text that a worker remembers.
WORK, PART_BYTES, REMEMBERED = 1 << 16, 1 << 20, 1 << 19
#: Pairs of ids that go to all tasks, 17 bytes each.
HEAD = 1 << 20

#: No UTF-8 text has this byte; it stands for the spaces at which texts are cut.
_CUT = 0xFF
_STRETCHES = split_at([_CUT], lower=False)
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE_WHITE = (0xC2, 0xE1, 0xE2, 0xE3)


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes are spaces where the texts, starting at ``at``, can be cut."""
    visible = ((raw > 0x20) & (raw < 0x7F)) | (raw >= 0x80)
    plain = visible & (raw < 0x80)
    maybe_white = np.isin(raw, _MAYBE_WHITE)
    out = raw == 0x20
    out[1:] &= visible[:-1]
    out[:-1] &= visible[1:]
    # Two characters beyond ASCII around the space, the second of which may be white: left alone.
    out[1:-1] &= ~maybe_white[2:] | plain[:-2]
    edges = np.concatenate([at[:-1], at[1:] - 1])
    out[edges[(edges >= 0) & (edges < len(raw))]] = False
    return out


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, pa.Array, bool]]:
    """(number of the first text, texts, whether the last of them ends here), in slices; a longer text comes in parts without the spaces between."""
    for begin, some in slices(texts, most):
        raw, _ = buffers(some)
        if len(some) > 1 or len(raw) <= most:
            yield begin, some, True
            continue
        place = 0
        while len(raw) - place > most:
            low, width = place + most, 1 << 12
            while True:
                window = raw[low - 1 : low + width]
                found = np.flatnonzero(cuts(window, np.array([0, len(window)])))
                if len(found) or low + width >= len(raw):
                    break
                width *= 4
            if not len(found):
                break
            end = low - 1 + int(found[0])
            yield begin, pa.array([raw[place:end].tobytes()], pa.large_binary()).cast(pa.large_string()), False
            place = end + 1
        yield begin, pa.array([raw[place:].tobytes()], pa.large_binary()).cast(pa.large_string()), True


class Side:
    """One tokenizer: the ids of stretches, and the bytes of each id."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.names = np.array([str(k) for k in range(len(pieces))], object)

    @staticmethod
    def byte_level(definition: str) -> Side:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        # Strings of special tokens in a text are plain text.
        tokenizer.encode_special_tokens = True
        # The public rule of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for characters from 256 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        names = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
        pieces = [bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode() for name in names]
        return Side(lambda texts: [e.ids for e in tokenizer.encode_batch([f" {t}" for t in texts], add_special_tokens=False)], pieces)

    @staticmethod
    def sentencepiece(model: bytes) -> Side:
        from sentencepiece import SentencePieceProcessor

        tokenizer = SentencePieceProcessor(model_proto=model)

        def piece(k: int) -> bytes:
            name = tokenizer.id_to_piece(k)
            return bytes([int(name[3:5], 16)]) if tokenizer.is_byte(k) else name.replace("▁", " ").encode()

        return Side(lambda texts: tokenizer.encode(texts, num_threads=1), [piece(k) for k in range(tokenizer.get_piece_size())])


class Memory:
    """What a tokenizer made of the stretches that it has seen: ids after each other."""

    def __init__(self, side: Side):
        self.side, self.begin, self.size, self.ids = side, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, texts: list[str]) -> np.ndarray:
        """Whether each of these texts comes back byte by byte, with a space before it."""
        found = self.side.encode(texts)
        pieces = self.side.pieces
        whole = np.array([b"".join([pieces[k] for k in ids]) == b" " + t.encode() for ids, t in zip(found, texts, strict=True)], bool)
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter((k for ids in found for k in ids), np.int32, int(size.sum()))])
        return whole

    def of(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these stretches, by number, after each other, and how many each has."""
        begin, size = self.begin[stretches], self.size[stretches]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)], size


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where merging the ascending lists a and b stands after every ``work`` steps: places in a, places in b."""
    step = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(step - len(b), 0), np.minimum(step, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # Of equal ends, that of a comes first.
        first = np.zeros(len(step), bool)
        first[open_] = a[middle[open_]] <= b[step[open_] - middle[open_] - 1]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, step - low
    # An end of b equal to the last of a goes to the same piece.
    split = np.flatnonzero((i > 0) & (j < len(b)))
    split = split[a[i[split] - 1] == b[j[split]]]
    j[split] += 1
    return i, j


class Overlaps(NamedTuple):
    """Tokens of a and of b, by place, that share bytes, in order, and whether they end together."""

    a: np.ndarray
    b: np.ndarray
    together: np.ndarray


def merge(a: np.ndarray, b: np.ndarray, i: int, j: int) -> Overlaps:
    """The overlaps of one piece: ends a from place i on, b from place j on. A token that ends after the piece is counted by its place too."""
    ends = np.concatenate([a, b])
    if not len(ends):
        return Overlaps(ends, ends, ends == 1)
    ends.sort(kind="stable")
    new = np.ones(len(ends), bool)
    new[1:] = ends[1:] != ends[:-1]
    together = ~np.append(new[1:], True)[new]
    last = np.append(np.flatnonzero(new)[1:], len(ends)) - 1
    # Ends of a that come before: all ends before, less those of b.
    in_a = np.searchsorted(a, ends[last])
    before = last - together - in_a
    return Overlaps(in_a + i, before + j, together)


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Overlaps:
    """All overlaps of tokens with these ascending ends: the pieces' overlaps after each other."""
    i, j = diagonals(a, b, work)
    found = [merge(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k]) for k in range(len(i) - 1)]
    return Overlaps(*(np.concatenate([np.zeros(0, kind), *column]) for kind, column in zip((np.int64, np.int64, bool), zip(*found, strict=True) if found else [()] * 3, strict=True)))


class Aligned(NamedTuple):
    """Some texts: of each, ids and groups; groups by the places of their last tokens."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    overlaps: Overlaps
    a_last: np.ndarray
    b_last: np.ndarray
    group_first: np.ndarray


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.forget()

    def forget(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.whole = np.zeros(0, bool)
        self.memories = Memory(self.a), Memory(self.b)

    def _numbers(self, words: Words) -> np.ndarray:
        """The numbers of these stretches in the memories; new ones are learnt."""
        seen, first, of = distinct(words.hash)
        at = np.searchsorted(self.known, seen)
        new = np.append(self.known, np.uint64(0))[at] != seen
        if not len(self.known):
            new[:] = True
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self.forget()
                new[:] = True
            texts = [words.text(k) for k in first[new]]
            whole = self.memories[0].learn(texts) & self.memories[1].learn(texts)
            known = np.concatenate([self.known, seen[new]])
            number = np.concatenate([self.number, len(self.whole) + np.arange(len(texts))])
            self.whole = np.concatenate([self.whole, whole])
            order = np.argsort(known)
            self.known, self.number = known[order], number[order]
            at = np.searchsorted(self.known, seen)
        return self.number[at][of]

    def __call__(self, texts: pa.Array, work: int = WORK) -> tuple[Aligned, np.ndarray]:
        """The alignment of texts, and which of them both tokenizers gave back; the others have no tokens."""
        raw, at = buffers(texts)
        data = raw.copy()
        data[cuts(raw, at)] = _CUT
        n = len(texts)
        words = Words(pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]), _STRETCHES)
        numbers = self._numbers(words)
        broken = np.bincount(words.doc, weights=~self.whole[numbers], minlength=n) > 0
        kept = ~broken[words.doc]
        numbers, doc = numbers[kept], words.doc[kept]
        sides = []
        for memory in self.memories:
            ids, size = memory.of(numbers)
            first = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=n).astype(np.int64))])
            sides.append((ids, first, np.cumsum(memory.side.size[ids])))
        (a_ids, a_first, a_ends), (b_ids, b_first, b_ends) = sides
        found = overlaps(a_ends, b_ends, work)
        a_last, b_last = found.a[found.together], found.b[found.together]
        return Aligned(a_ids, b_ids, a_first, b_first, found, a_last, b_last, np.searchsorted(a_last, a_first)), ~broken


def group_texts(side_a: Side, side_b: Side, x: Aligned) -> list[str]:
    """Of each text, its groups as ``a1,a2|b1;`` after each other."""
    n_a, n_b = len(x.a_ids), len(x.b_ids)
    out = np.empty(2 * (n_a + n_b), object)
    a_group, b_group = np.searchsorted(x.a_last, np.arange(n_a)), np.searchsorted(x.b_last, np.arange(n_b))
    # A token stands after its own kind's earlier tokens, and after the other kind's of earlier groups (b: of its own group too).
    b_before = np.concatenate([[-1], x.b_last]) + 1
    a_at = 2 * (np.arange(n_a) + b_before[a_group])
    b_at = 2 * (np.arange(n_b) + x.a_last[b_group] + 1) if n_b else np.zeros(0, np.int64)
    out[a_at], out[b_at] = side_a.names[x.a_ids], side_b.names[x.b_ids]
    out[a_at + 1] = out[b_at + 1] = ","
    out[a_at[x.a_last] + 1], out[b_at[x.b_last] + 1] = "|", ";"
    first = 2 * (x.a_first + x.b_first)
    return ["".join(out[i:j].tolist()) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(a: str, b: bytes) -> Aligner:
    """One aligner per worker and pair of tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash((a, b))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(Side.byte_level(a), Side.sentencepiece(b))
    return _ALIGNERS[key]


def _definitions(spark: SparkSession, a_path: str, b_path: str):
    return spark.sparkContext.broadcast((Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()))


def alignments(docs: DataFrame, a_path: str, b_path: str, most: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ids of both tokenizers, how many tokens of each every group has, and the overlaps by places.

    ``a_path`` is a byte-level tokenizer's definition, ``b_path`` a sentencepiece model.
    """
    definitions = _definitions(docs.sparkSession, a_path, b_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("a_ids", "b_ids", "a_sizes", "b_sizes", "a_overlaps", "b_overlaps")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(*definitions.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), strings(batch.column("text"))
            held: list[list[np.ndarray]] = []
            for begin, some, ends in parts(texts, most):
                x, good = align(some)
                at = np.searchsorted(x.overlaps.a, x.a_first)
                for k in range(len(some)):
                    (i, i_), (j, j_), (g, g_), (o, o_) = ((f[k], f[k + 1]) for f in (x.a_first, x.b_first, x.group_first, at))
                    sizes = (np.diff(last[g:g_], prepend=first - 1) for last, first in ((x.a_last, i), (x.b_last, j)))
                    held.append([x.a_ids[i:i_], x.b_ids[j:j_], *sizes, x.overlaps.a[o:o_] - i, x.overlaps.b[o:o_] - j, good[k]])
                if not ends:
                    continue
                done = [_one_text(held)] if len(some) == 1 else [h[:-1] for h in held]
                schema = pa.schema([("doc_id", ids.type), *[(c, pa.list_(pa.int32())) for c in names]])
                yield rows(schema, doc_id=ids.slice(begin, len(some)), **{c: [d[k].astype(np.int32) for d in done] for k, c in enumerate(names)})
                held = []

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in names))


def _one_text(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The parts of one text after each other; nothing if one of them was not given back."""
    if not all(h[-1] for h in held):
        return [np.zeros(0, np.int64)] * 6
    shift = np.cumsum([[0, 0], *[[len(h[0]), len(h[1])] for h in held]], axis=0)
    moved = [[*h[:4], h[4] + i, h[5] + j] for h, (i, j) in zip(held, shift[:-1], strict=True)]
    return [np.concatenate(column) for column in zip(*moved, strict=True)]


_LONGS = ("n_a", "n_b", "n_groups", "n_links")


class _Long:
    """What is known of a text that comes in parts."""

    def __init__(self):
        self.good, self.counts, self.pairs, self.sha, self.waits = True, np.zeros((1, 4), np.int64), (np.zeros(0, np.int64),) * 2, hashlib.sha256(), ""

    def add(self, good: bool, counts: np.ndarray, code: np.ndarray, names: str) -> None:
        self.good, self.counts = self.good and bool(good), self.counts + counts
        held, times = self.pairs
        self.pairs = _counted(np.concatenate([held, code]), np.concatenate([times, np.ones(len(code), np.int64)]))
        self.sha.update(self.waits.encode())
        self.waits = names

    def done(self):
        if not self.good:
            return np.zeros((1, 4), np.int64), [""], [(np.zeros(0, np.int64),) * 2]
        # Without the last separator.
        self.sha.update(self.waits[:-1].encode())
        return self.counts, [self.sha.hexdigest()], [self.pairs]


def _digests(docs: DataFrame, a_path: str, b_path: str, most: int) -> DataFrame:
    """Per row a number, sizes, the hash of the groups, and the distinct pairs of ids that end together with their numbers."""
    definitions = _definitions(docs.sparkSession, a_path, b_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align = _aligner(*definitions.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column("doc_id"), strings(batch.column("text"))
            schema = pa.schema(
                [("row", pa.int64()), ("doc_id", ids.type), *[(c, pa.int64()) for c in _LONGS], ("groups_sha256", pa.string()),
                 ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
            )
            long = None
            for begin, some, ends in parts(texts, most):
                n = len(some)
                x, good = align(some)
                names = group_texts(align.a, align.b, x)
                counts = np.stack([np.diff(f) for f in (x.a_first, x.b_first, x.group_first, x.group_first)], axis=1)
                code = (x.a_ids[x.a_last].astype(np.int64) << 32) | x.b_ids[x.b_last]
                if long or not ends:
                    long = long or _Long()
                    long.add(good[0], counts[0], code, names[0])
                    if not ends:
                        continue
                    (counts, hashes, held), long = long.done(), None
                else:
                    hashes = [hashlib.sha256(t[:-1].encode()).hexdigest() if t else "" for t in names]
                    held = [_counted(code[i:j]) for i, j in zip(x.group_first[:-1], x.group_first[1:], strict=True)]
                yield rows(
                    schema, row=np.arange(number, number + n), doc_id=ids.slice(begin, n), groups_sha256=hashes, **{c: counts[:, k] for k, c in enumerate(_LONGS)},
                    pairs=[p for p, _ in held], times=[t for _, t in held],
                )
                number += n

    longs = ", ".join(f"{c} long" for c in _LONGS)
    return durable(docs.select("doc_id", "text").mapInArrow(task, f"row long, doc_id {kind}, {longs}, groups_sha256 string, pairs array<long>, times array<int>"))


def _counted(code: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(code, return_counts=True)
    held, of = np.unique(code, return_inverse=True)
    return held, np.bincount(of, weights=times, minlength=len(held)).astype(np.int64)


def _least(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs of ``counts(pair, n)`` reach."""
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).collect()}
    power = max(sizes, default=0) + 1
    left = most
    while power and sizes.get(power - 1, 0) <= left:
        power -= 1
        left -= sizes.get(power, 0)
    return 1 << power


def alignment_report(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, most: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, as in op12."""
    found = _digests(docs, a_path, b_path, most)
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = durable(each.groupBy("pair").agg(F.sum(F.col("n").cast("long")).alias("n")))
    # One id of B has at most as many partners as A has ids.
    by_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = durable(counts.select("pair", "n", (F.col("n") == F.max("n").over(by_b)).alias("best")))
    least = _least(counts, head)
    often = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(often.column("pair").to_numpy())
    often = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    kind = found.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = often.value
        pair = np.append(pair, -1)
        n, best = np.append(n, 0), np.append(best, False)
        for batch in batches:
            held = batch.column("pairs")
            at = held.offsets.to_numpy()
            codes, times = held.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            place = np.searchsorted(pair[:-1], codes)
            known = pair[place] == codes
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))

            def total(what, row=row):
                out = np.zeros(batch.num_rows, np.int64)
                np.add.at(out, row, what)
                return out

            rest = np.concatenate([[0], np.cumsum(~known)])[at - at[0]]
            lists = {c: pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(v[~known], t)) for c, v, t in (("pairs", codes, pa.int64()), ("times", times, pa.int32()))}
            names = [c for c in batch.schema.names if c not in lists]
            columns = [batch.column(c) for c in names] + [pa.array(total(times * known * w[place])) for w in (best, n)] + list(lists.values())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum", *lists])

    longs = ", ".join(f"{c} long" for c in _LONGS)
    scored = found.mapInArrow(score, f"row long, doc_id {kind}, {longs}, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<int>")
    columns = ["doc_id", *_LONGS, "n_best", "count_sum", "groups_sha256"]
    if least <= 1:
        return scored.select(columns)
    scored = durable(scored)
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    rare = rare.join(counts.where(F.col("n") < least), "pair").groupBy(F.col("row").alias("its_row"))
    rare = rare.agg(F.sum(F.col("t") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    out = scored.join(rare, F.col("row") == F.col("its_row"), "left")
    out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(columns)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_report(table(spark, sf_dir, "documents"), a, b)


def queries():
    return {"op12_token_alignment": op12_token_alignment}

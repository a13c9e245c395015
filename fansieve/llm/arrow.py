"""Texts as Arrow buffers: words, shingles and their hashes for whole batches at once, without a Python object per word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, which bounds a worker's memory; one longer text is a slice alone.
SLICE_BYTES = 1 << 20
#: Bytes whose words are hashed at a time.
HASHED_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (int(n) - 1).bit_length())
        tables = [np.full(size, base, np.uint64) for base in (_BASE, _INVERSE)]
        for t in tables:
            t[0] = 1
        _POWERS[:] = [np.cumprod(t, dtype=np.uint64) for t in tables]
    return _POWERS


def _long_sum(word: np.ndarray) -> np.uint64:
    """What ``Words`` sums up over the bytes of a word, for one that is too long for tables of powers."""
    total = 0
    for begin in range(0, len(word), HASHED_BYTES):
        some = word[begin : begin + HASHED_BYTES]
        power, _ = _powers(len(some))
        part = int(((some.astype(np.uint64) + np.uint64(1)) * power[: len(some)]).sum(dtype=np.uint64))
        total += part * pow(_BASE, begin, 1 << 64)
    return np.uint64(total % (1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that every bit depends on every other."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers between 0 and 1, both excluded."""
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Split(NamedTuple):
    """Which bytes separate words, and what each byte becomes."""

    separates: np.ndarray
    becomes: np.ndarray


def split_at(separators, lower: bool) -> Split:
    """Words are what stands between these bytes; A-Z become a-z if ``lower``."""
    separates, becomes = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    separates[list(separators)] = True
    if lower:
        becomes[ord("A") : ord("Z") + 1] += 32
    return Split(separates, becomes)


WHITE = [0x20, *range(0x09, 0x0E)]
#: Words are runs without white space; letters A-Z as they are, or as a-z.
BY_WHITE = split_at(WHITE, lower=False)
BY_WHITE_LOWER = split_at(WHITE, lower=True)
#: Words are runs of 0-9, a-z (A-Z before) and everything beyond ASCII.
ALPHANUMERIC = split_at([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def strings(column) -> pa.Array:
    """A text column as one large-string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes (UTF-8) after each other, and where each begins; one more entry for the end."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=8 * texts.offset)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive runs of texts of at most ``most`` bytes together, or a single longer one: (index of the first, run)."""
    _, at = buffers(texts)
    begin, n = 0, len(texts)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield begin, texts.slice(begin, end - begin)
        begin = end


class Words:
    """The words of several texts: which text (``doc``), their bytes (``data[start:end]``), and a 64-bit hash of each."""

    def __init__(self, texts: pa.Array, split: Split, kinds: np.ndarray | None = None):
        """``kinds`` (of each byte: 1, 2 or 0) also cuts words between a byte of kind 1 and one of kind 2."""
        raw, at = buffers(texts)
        self.n_docs, n = len(texts), len(raw)
        data = self.data = split.becomes[raw]
        inside = ~split.separates[data]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        if kinds is not None and n:
            kind = kinds[data]
            cut[1:-1] |= kind[1:] * kind[:-1] == 2
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        h = np.empty(len(self.start), np.uint64)
        # Some words at a time, as each byte takes eight here.
        cuts = np.unique(np.append(np.searchsorted(self.start, np.arange(0, n, HASHED_BYTES)), len(h)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if self.end[j - 1] - self.start[j - 1] > HASHED_BYTES:
                j -= 1
                h[j] = _long_sum(data[self.start[j] : self.end[j]])
            if i == j:
                continue
            low, high = self.start[i], self.end[j - 1]
            power, inverse = _powers(high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=total[1:])
            h[i:j] = (total[self.end[i:j] - low] - total[self.start[i:j] - low]) * inverse[self.start[i:j] - low]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, at)  # of each text, its first word; one more entry for the end
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def word_hash(*words: str) -> np.ndarray:
    """The hashes that ``Words`` gives these words."""
    return Words(pa.array(words, pa.large_string()), BY_WHITE).hash


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in ascending order, the place of one of each, and of each hash its number among the distinct ones."""
    if len(h) == 0:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    ordered = h[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a shorter text with any word has one, of all its words."""
    h, n = words.hash, len(words.hash)
    first, counts = words.first, words.counts
    runs = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    doc = np.repeat(np.arange(words.n_docs), runs)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[:-1], runs)
    last = first[1:][doc]
    out = np.zeros(len(doc), np.uint64)
    for k in range(size):
        at = begin + k
        there = at < last
        out = out * np.uint64(0xA24BAED4963EE407) + np.where(there, h[np.minimum(at, n - 1)], np.uint64(k + 1)) if n else out
    return doc, mix(out)


def crc32_mod(ids, modulus: int) -> np.ndarray:
    """crc32 of each id written in decimal, modulo ``modulus``; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], np.int64)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of these columns, given as arrays, in the order of the schema."""
    made = []
    for f in schema:
        c = columns[f.name]
        made.append(c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def keep_rows(docs, keep, most: int = SLICE_BYTES):
    """The rows of the DataFrame ``docs`` for whose texts ``keep`` (of an array of strings) is true. Only texts reach Python."""
    from pyspark.sql import functions as F

    @F.arrow_udf("boolean")
    def kept(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            parts = [np.asarray(keep(part), bool) for _, part in slices(strings(some), most)]
            yield pa.array(np.concatenate([np.zeros(0, bool), *parts]), pa.bool_())

    return docs.where(kept(F.col("text")))

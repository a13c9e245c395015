"""Cost-balanced packing of documents into training sequences.

A document's tokens cost ``linear * n + quadratic * n * n`` (feed-forward and attention). Every task tokenises its documents and, chunk by
chunk, deals them in descending length to the sequence with the lowest cost so far that has room; a document that fits nowhere is cut.
A chunk makes only as many sequences as it can fill; what is left, less than one sequence, goes on to the next chunk. What
the tasks have left at their end meets in a second step, so that there is one partly filled sequence for every ``TAILS`` tasks.
No document's tokens are shuffled except those leftovers.

Cases: a null text is an empty one, and an empty one has only its end token; a document longer than a sequence is cut into whole
sequences and a rest; repeated rows are packed as often as they occur; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fansieve.llm.arrow import BY_WHITE, BY_WHITE_LOWER, Words, buffers, distinct, slices, strings
from fansieve.session import durable, table

LENGTH = 4096
END = 2
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Tokens that a task packs at a time.
CHUNK = 1 << 20
#: Tasks whose leftovers are packed together.
TAILS = 64
#: Words whose tokens a worker remembers; beyond, it forgets all and starts anew. Words that are sent to the tokenizer at a time.
REMEMBERED, AT_ONCE = 500_000, 20_000

#: 1 for letters, 2 for marks that neither begin a contraction nor occur in a special token.
MARKS = b".,!?;:$%&*#()"
KINDS = np.zeros(256, np.uint8)
KINDS[list(range(ord("a"), ord("z") + 1))] = 1
KINDS[list(MARKS)] = 2

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tail long, ids binary"


class WordTokens:
    """Token ids of whole texts, from the tokens of their words.

    The tokenizer neither looks across white space nor keeps it, and never joins a letter a-z with one of the marks in ``MARKS``, so a text's
    ids are those of its words and runs of marks after each other. It lowers letters too, after it has taken out its special
    tokens; texts that may hold one keep their case here. Only words not seen before are sent to the tokenizer.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, new: np.ndarray, texts: list[str]) -> None:
        sizes, ids = [], []
        for k in range(0, len(texts), AT_ONCE):
            some = texts[k : k + AT_ONCE]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum(lengths + 1) - lengths - 1
            at = np.array([b for b, _ in encoded.offsets], np.int64)
            sizes.append(np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(some)))
            ids.append(np.array(encoded.ids, np.uint32))
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size) - size
        known = np.concatenate([self.known, new])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, *ids])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, each text's followed by the end token; how many each has."""
        raw, _ = buffers(texts)
        special = bool(((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))).any())
        words = Words(texts, BY_WHITE if special else BY_WHITE_LOWER, None if special else KINDS)
        seen, first, of = distinct(words.hash)
        at = np.searchsorted(self.known, seen)
        new = np.append(self.known, np.uint64(0))[at] != seen
        if new.any():
            if len(self.known) + len(seen) > REMEMBERED:
                self.forget()
                new[:] = True
            self._learn(seen[new], [words.text(i) for i in first[new]])
            at = np.searchsorted(self.known, seen)
        begin, size = self.begin[at][of], self.size[at][of]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        counts = np.diff(total[words.first])
        return np.insert(flat, np.cumsum(counts), END).astype(np.uint32), counts + 1


_TOKENIZERS: dict[int, WordTokens] = {}


def word_tokens(definition: str) -> WordTokens:
    """One tokenizer per worker and definition; tasks that follow each other share what it remembers."""
    key = hash(definition)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokens(definition)
    return _TOKENIZERS[key]


class Piece:
    """``ids`` of one document from ``start`` on; the document has ``total``."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


def pack(pieces: list[Piece], length: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the pieces that are left, less than ``length`` tokens; if ``last``, these are a sequence too."""
    sequences, rest = [], []
    for p in pieces:
        while len(p.ids) >= length:
            whole, p = p.cut(length)
            sequences.append([whole])
        if len(p.ids):
            rest.append(p)
    number = sum(len(p.ids) for p in rest) // length
    cost, room = np.zeros(number), np.full(number, length)
    dealt: list[list[Piece]] = [[] for _ in range(number)]
    queue = [(-len(p.ids), k, p) for k, p in enumerate(rest)]
    heapq.heapify(queue)
    left, k = [], len(rest)
    while queue:
        _, _, p = heapq.heappop(queue)
        n = len(p.ids)
        fits = room >= n
        if not fits.any():
            fits = room > 0
            if not fits.any():
                left.append(p)
                continue
        i = int(np.argmin(np.where(fits, cost, np.inf)))
        if room[i] < n:
            p, more = p.cut(int(room[i]))
            heapq.heappush(queue, (-len(more.ids), k, more))
            n, k = len(p.ids), k + 1
        dealt[i].append(p)
        room[i] -= n
        cost[i] += LINEAR * n + QUADRATIC * n * n
    sequences += dealt
    return (sequences + [left], []) if last and left else (sequences, left)


def _batch(sequences: list[list[Piece]], number: int, tail: int | None, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of whole sequences, numbered from ``number`` on, or of pieces left for ``tail``, which keep their ids."""
    out = {f.name: [] for f in schema}
    for k, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            data = p.ids.astype("<u4").tobytes()
            for name, value in zip(
                out,
                (p.doc, p.start, len(p.ids), zlib.crc32(data), p.total, None if tail is not None else number + k, offset, tail, data if tail is not None else None),
                strict=True,
            ):
                out[name].append(value)
            offset += len(p.ids)
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tail")
    return pa.schema([("doc_id", id_type), *[(n, pa.int64()) for n in longs], ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Pack ``docs(doc_id, text)`` with the tokenizer in the file ``tokenizer``: one row per piece, as in op8."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens_of = word_tokens(definition.value)
        part = TaskContext.get().partitionId()
        number, waiting, held, schema = part << 32, [], 0, None
        for batch in batches:
            ids, texts = batch.column("doc_id"), strings(batch.column("text"))
            schema = schema or _schema(ids.type)
            for begin, some in slices(texts):
                flat, counts = tokens_of(some)
                ends = np.cumsum(counts)
                names = ids.slice(begin, len(some)).to_pylist()
                for doc, to, n in zip(names, ends.tolist(), counts.tolist(), strict=True):
                    waiting.append(Piece(doc, 0, flat[to - n : to], n))
                held += len(flat)
                if held >= CHUNK:
                    sequences, waiting = pack(waiting, length, last=False)
                    waiting = [Piece(p.doc, p.start, p.ids.copy(), p.total) for p in waiting]
                    held = sum(len(p.ids) for p in waiting)
                    yield _batch(sequences, number, None, schema)
                    number += len(sequences)
        if waiting:
            sequences, waiting = pack(waiting, length, last=False)
            yield _batch(sequences, number, None, schema)
            if waiting:
                yield _batch([waiting], 0, part // TAILS, schema)

    def tails(table: pa.Table) -> pa.Table:
        schema = table.schema
        # The order in which rows arrive is not fixed; this one is.
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        pieces = [
            Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            for r in table.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist()
        ]
        number = (1 << 62) + (table.column("tail")[0].as_py() << 32)
        sequences, _ = pack(pieces, length, last=True)
        return pa.Table.from_batches([_batch(sequences, number, None, schema)])

    kind = PIECE.format(id=docs.schema["doc_id"].dataType.simpleString())
    first = durable(docs.select("doc_id", "text").mapInArrow(task, kind))
    rest = first.where(F.col("tail").isNotNull()).groupBy("tail").applyInArrow(tails, kind)
    return first.where(F.col("tail").isNull()).unionByName(rest).drop("tail", "ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def queries():
    return {"op8_packing": op8_packing}

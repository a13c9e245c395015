"""Near-duplicate documents by ProbMinHash on shingles.

A text's shingles are its runs of five words (a shorter text has one, of all its words). Every shingle sends a Poisson process of arrivals, with its
weight as the rate, to random registers; a register keeps the shingle that arrives first, so two texts agree in a register with the
probability Jaccard similarity. All distinct shingles of a text have the same weight, however often they occur: so that is the Jaccard
similarity of the sets of shingles, by which texts are linked in the end. A shingle stops when its next arrival comes after the latest of
the text's registers, so hardly more arrivals are drawn than registers are filled.

1. Equal texts, or texts with equal sets of shingles, are one content; one of them stands for all from here on.
2. Bands of registers put contents into buckets. In each bucket, all are compared with its most central content, the one that sits
   in the largest buckets over all bands; so a group of copies of one text costs one comparison per copy, not one per pair.
3. Buckets whose contents are not all connected by then are looked at as a whole, each in one task: contents of different components whose
   registers agree are compared too, and only the links that join components come out.
   Very large buckets: all are compared with a few more of the bucket, drawn by a hash. The contents of those that are still not all connected are
   joined by an exact set-similarity join, over all such buckets at once: shingles ordered by how many of these contents have them, rarest first,
   with prefix, length and positional filters. A shingle that very many contents have is dealt to cells. No pair is left out, and no registers are asked.
4. Compared, but for that join, means: if the registers agree in ``AGREE`` of their places, the exact Jaccard similarity of the sets of shingles is taken; texts are
   linked from ``SIMILARITY`` on. Classes are the connected components of the links.

Cases: a null or wordless text has no shingles and is a class of its own; white space and nothing else separates words, and case counts;
rows with the same doc_id are rows of their own (repeated rows are copies); an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansieve.llm.arrow import BY_WHITE, Words, mix, rows, shingles, slices, strings, uniform
from fansieve.llm.graph import FREQUENT_KEYS, FREQUENT_ROWS, components, few, uneven_join
from fansieve.session import durable, table

SIZE, SIMILARITY = 5, 0.8
REGISTERS, BANDS, ROWS = 256, 16, 4
#: Registers in which two texts must agree to be compared: 0.8 less three standard deviations.
AGREE = 0.72
#: Contents of a bucket that are looked at together, and their shingles; larger buckets are joined exactly.
TOGETHER, ALL_SHINGLES = 2048, 8 << 20
#: Contents that are drawn in a larger bucket to be compared with all others, and the contents of a shingle that meet all its others in one cell.
DRAWN, CELL = 8, 4096
#: For products of the similarity with sizes, which may be rounded up: filters let through a little more.
SLACK = 1e-6


def weighted(words: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of the distinct shingles of each text, in ascending order."""
    doc, h = shingles(words, size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def sketch(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle in each register of each text [text, register]; 0 in texts without shingles."""
    first = np.full(n_docs * registers, np.inf)
    holds = np.zeros(n_docs * registers, np.uint64)
    seed = mix(h)
    when = -np.log(uniform(seed)) / weight
    at, turn = np.arange(len(h)), 0
    while len(at):
        turn += 1
        draw = mix(seed[at] + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        register = doc[at] * registers + (draw >> np.uint64(40)).astype(np.int64) % registers
        np.minimum.at(first, register, when[at])
        won = first[register] == when[at]
        holds[register[won]] = h[at[won]]
        latest = first.reshape(n_docs, registers).max(axis=1)
        when[at] += -np.log(uniform(mix(draw))) / weight[at]
        at = at[when[at] < latest[doc[at]]]
    return holds.reshape(n_docs, registers)


def _sketches(docs: DataFrame) -> DataFrame:
    """Per row: a number, content keys, bucket keys, and a byte of every register."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            schema = pa.schema(
                [("row", pa.int64()), ("doc_id", ids.type), ("text_key", pa.int64()), ("shingles", pa.int64()), ("key", pa.binary()),
                 ("buckets", pa.list_(pa.int64())), ("registers", pa.binary())]
            )
            for begin, some in slices(strings(batch.column("text"))):
                n = len(some)
                doc, h, _ = weighted(Words(some, BY_WHITE))
                # Equal weights: the registers must estimate the similarity that is verified.
                held = sketch(doc, h, np.ones(len(h)), n)
                count = np.bincount(doc, minlength=n)
                # Two sums over all distinct shingles: 128 bits that tell contents apart.
                keys = np.zeros((n, 2), np.uint64)
                for k, salt in enumerate((0x51ED270B, 0xC2B2AE35)):
                    np.add.at(keys[:, k], doc, mix(h * np.uint64(2 * salt + 1)))
                bands = held[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
                bucket = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    bucket = mix(bucket * np.uint64(0xA24BAED4963EE407) + bands[:, :, k])
                small = (mix(held) & np.uint64(255)).astype(np.uint8)
                yield rows(
                    schema, row=np.arange(number, number + n), doc_id=ids.slice(begin, n), text_key=batch.column("text_key").slice(begin, n), shingles=count,
                    key=[k.tobytes() for k in keys],
                    buckets=pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * n + 1, BANDS), pa.int32()), pa.array(bucket.ravel().view(np.int64))),
                    registers=[r.tobytes() for r in small],
                )
                number += n

    kind = f"row long, doc_id {id_type}, text_key long, shingles long, key binary, buckets array<long>, registers binary"
    return durable(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(task, kind))


def _agreeing(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose registers agree."""
    registers = contents.select("row", "registers")
    both = pairs.join(registers.toDF("a", "a_registers"), "a").join(registers.toDF("b", "b_registers"), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("a_registers", "b_registers"))
                keep = pa.array((x == y).mean(axis=1) >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(task, "a long, b long")


def _sets(wanted: DataFrame, contents: DataFrame, docs: DataFrame) -> DataFrame:
    """``(row, shingle_set)``, the distinct shingles in ascending order, of the contents ``wanted(row)``; their texts are read again."""
    wanted = durable(wanted.join(contents.select("row", "doc_id", "text_key"), "row"))
    wanted = few(wanted.select("row", F.col("doc_id").alias("its_doc"), F.col("text_key").alias("its_key")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("text_key") == F.col("its_key"))).select("row", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, some in slices(strings(batch.column("text"))):
                doc, h, _ = weighted(Words(some, BY_WHITE))
                cuts = np.searchsorted(doc, np.arange(len(some) + 1))
                data = [h[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(begin, len(some)), pa.array(data, pa.binary())], names=["row", "shingle_set"])

    # Rows repeated in the input come several times, all the same.
    return durable(texts.mapInArrow(sets, "row long, shingle_set binary").groupBy("row").agg(F.first("shingle_set").alias("shingle_set")))


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared)


def _linked(pairs: DataFrame, contents: DataFrame, docs: DataFrame, similarity: float, held: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs(a, b)``, stored, whose sets of shingles have this Jaccard similarity. ``held`` are the sets if they are there already."""
    held = held if held is not None else _sets(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "row"), contents, docs)
    both = pairs.join(held.toDF("a", "a_set"), "a").join(held.toDF("b", "b_set"), "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("a_set"), batch.column("b_set"), strict=True)
            keep = pa.array([_similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in two), similarity) for two in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return durable(both.mapInArrow(task, "a long, b long"))


def central_pairs(members: DataFrame) -> DataFrame:
    """Each content of ``members(bucket, row)`` with the most central one of each of its buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = durable(members.select("bucket", "row").join(sizes, "bucket"))
    rank = members.groupBy("row").agg(F.sum("size").alias("rank"))
    members = durable(members.join(rank, "row").select("bucket", "row", "rank"))
    # The highest rank, and of these the smallest row: two plain maxima, summed up in the tasks first.
    top = members.groupBy("bucket").agg(F.max("rank").alias("top"))
    best = members.join(top, "bucket").where(F.col("rank") == F.col("top")).groupBy("bucket").agg(F.min("row").alias("center"))
    pairs = members.join(best, "bucket").where(F.col("row") != F.col("center"))
    return pairs.select(F.least("row", "center").alias("a"), F.greatest("row", "center").alias("b")).distinct()


def _crossing(members: DataFrame) -> DataFrame:
    """``members`` of buckets in which not all have the same label, with how many members the bucket has (``n``), and shingles (``all``)."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("shingles").alias("all"), F.min("label").alias("least"), F.max("label").alias("most"))
    return members.join(sizes.where(F.col("least") < F.col("most")).select("bucket", "n", "all"), "bucket")


def _registers(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _with_partner(members: DataFrame) -> DataFrame:
    """Those of ``members(bucket, row, label, registers)`` whose registers agree with those of another label in the same bucket."""

    def group(table: pa.Table) -> pa.Table:
        label, held = table.column("label").to_numpy(), _registers(table)
        there = np.zeros(len(label), bool)
        for k in range(len(label) - 1):
            other = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
            close = other[(held[other] == held[k]).mean(axis=1) >= AGREE]
            there[close] = True
            there[k] |= len(close) > 0
        return table.filter(pa.array(there))

    kind = "bucket long, row long, label long, registers binary"
    return members.select("bucket", "row", "label", "registers").groupBy("bucket").applyInArrow(group, kind)


def _links_inside(members: DataFrame, similarity: float) -> DataFrame:
    """Links that join the labels of ``members(bucket, row, label, registers, shingle_set)`` within buckets, no more than it takes."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        row, label, held = table.column("row").to_numpy(), table.column("label").to_numpy().copy(), _registers(table)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingle_set").to_pylist()]
        links = []
        for k in range(len(row) - 1):
            agree = (held[k + 1 :] == held[k]).mean(axis=1)
            for other in k + 1 + np.argsort(-agree, kind="stable")[: int((agree >= AGREE).sum())]:
                if label[other] != label[k] and _similar(sets[k], sets[other], similarity):
                    links.append((row[k], row[other]))
                    label[label == label[other]] = label[k]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return members.groupBy("bucket").applyInArrow(group, "a long, b long")


def _drawn_pairs(members: DataFrame) -> DataFrame:
    """Each content of ``members(bucket, row, label)`` with ``DRAWN`` of its bucket, as far as their labels differ."""
    draws = [F.min(F.struct(F.xxhash64("row", F.lit(t)).alias("draw"), "row", "label")) for t in range(DRAWN)]
    drawn = members.groupBy("bucket").agg(F.array(*draws).alias("drawn")).select("bucket", F.explode("drawn").alias("one"))
    drawn = few(durable(drawn.select("bucket", F.col("one.row").alias("its_row"), F.col("one.label").alias("its_label"))))
    pairs = members.join(drawn, "bucket").where(F.col("label") != F.col("its_label"))
    return pairs.select(F.least("row", "its_row").alias("a"), F.greatest("row", "its_row").alias("b")).distinct()


def _tokens(sets: DataFrame) -> DataFrame:
    """A row ``(row, label, size, h)`` for each shingle of each of ``sets(row, label, shingle_set)``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("shingle_set").to_pylist()
            size = np.array([len(d) // 8 for d in data], np.int64)
            ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            every = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(data), np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), pa.array(size), every], names=["row", "label", "size", "every"])

    sets = sets.select("row", "label", "shingle_set").mapInArrow(task, "row long, label long, size long, every array<long>")
    return sets.select("row", "label", "size", F.explode("every").alias("h"))


def _candidates(sets: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(row, label, shingle_set)``, stored, of different labels: all that have this Jaccard similarity, and few others.

    Such a pair shares at least s / (1 + s) of the sum of both sizes. So many shingles, its rarest shared one included, come from there to
    the end in both: that is at least s of the longer one's size and 2 s / (1 + s) of the shorter one's. Shingles within one label do not count.
    """
    tokens = _tokens(sets)
    counts = tokens.groupBy("h").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    counts = durable(counts.where(F.col("least") < F.col("most")).select(F.col("h").alias("token"), "n"))
    many = max(FREQUENT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT_KEYS)
    hot = durable(counts.where(F.col("n") > many).select(F.col("token").alias("frequent")))
    shared = uneven_join(tokens, counts, "h", "token", heavy=hot)
    # How many come from this one to the end, itself included.
    left = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("n"), F.desc("h")))
    prefixes = shared.select("h", "row", "label", "size", left.alias("left")).where(F.col("left") >= similarity * F.col("size") - SLACK)
    shorter = F.col("left") * (1 + similarity) >= 2 * similarity * F.col("size") - SLACK
    prefixes = durable(prefixes.withColumn("shorter", shorter.cast("long")))

    # Pairs within a shingle's most frequent label are never met: its contents meet those of other labels, and these one another.
    groups = prefixes.groupBy("h", "label").agg(F.count("*").alias("n"), F.sum("shorter").alias("shorter"))
    groups = groups.groupBy("h").agg(F.count("*").alias("labels"), F.sum("shorter").alias("shorter"), F.max(F.struct("n", "label", "shorter")).alias("top"))
    groups = groups.where((F.col("labels") > 1) & (F.col("shorter") > 0)).select(
        F.col("h").alias("token"), F.col("top.label").alias("major"), F.ceil((F.col("shorter") - F.col("top.shorter")) / cell).alias("minor_cells"),
        F.ceil(F.col("shorter") / cell).alias("cells"),
    )
    prefixes = durable(uneven_join(prefixes, durable(groups), "h", "token").drop("token"))
    minor = F.col("label") != F.col("major")
    side = F.explode(F.when(minor, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    x = prefixes.where(F.col("shorter") == 1).withColumn("side", side)
    x = x.withColumn("cell", F.pmod(F.xxhash64("row"), F.when(F.col("side") == 0, F.col("minor_cells")).otherwise(F.col("cells"))))
    x = x.select("h", "side", "cell", F.col("row").alias("a"), F.col("label").alias("a_label"), F.col("size").alias("a_size"), F.col("left").alias("a_left"))
    y = prefixes.withColumn("side", minor.cast("int")).withColumn("to", F.when(minor, F.col("cells")).otherwise(F.col("minor_cells")))
    y = y.where(F.col("to") > 0).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to") - 1)))
    y = y.select("h", "side", "cell", F.col("row").alias("b"), "label", "size", "left")
    possible = F.least("left", "a_left") * (1 + similarity) >= similarity * (F.col("size") + F.col("a_size")) - SLACK
    in_order = (F.col("a_size") < F.col("size")) | ((F.col("a_size") == F.col("size")) & (F.col("a") < F.col("b")))
    # Every pair of different labels that shares one of these shingles is looked at, once for each such shingle.
    return y.join(x, ["h", "side", "cell"]).where((F.col("a_label") != F.col("label")) & in_order & possible).select("a", "b").distinct()


def _rest(members: DataFrame, links: DataFrame, contents: DataFrame, docs: DataFrame, similarity: float, together: int, cell: int = CELL) -> DataFrame:
    """``links`` and those of contents of ``members(bucket, row, label, registers, shingles)`` across labels, see 3. at the top."""
    members = durable(_crossing(members))
    large = (F.col("n") > together) | (F.col("all") > ALL_SHINGLES)
    close = durable(_with_partner(members.where(~large)))
    inside = close.join(_sets(close.select("row").distinct(), contents, docs), "row").select("bucket", "row", "label", "registers", "shingle_set")
    links = durable(links.union(_links_inside(inside, similarity)))
    members = members.where(large).select("bucket", "row", "label")
    if not members.head(1):
        return links
    links = durable(links.union(_linked(durable(_agreeing(_drawn_pairs(members), contents)), contents, docs, similarity)))
    members = members.drop("label").join(components(links), F.col("row") == F.col("node"), "left")
    members = members.select("bucket", "row", F.coalesce("label", "row").alias("label"), F.lit(0).alias("shingles"))
    left = durable(_crossing(durable(members)).select("row", "label").distinct())
    held = _sets(left.select("row"), contents, docs)
    pairs = durable(_candidates(durable(held.join(left, "row")), similarity, cell))
    return links.union(_linked(pairs, contents, docs, similarity, held))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, together: int = TOGETHER) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``class_id`` (the smallest doc_id of its class), ``class_size``,
    ``kept`` (true for one row of each class, one with the smallest doc_id), ``shingles``, and ``text_key``, a hash of the text.
    """
    sketches = _sketches(docs)
    with_any = sketches.where(F.col("shingles") > 0)
    # One row stands for all with the same shingles.
    stands = durable(with_any.groupBy("key").agg(F.min("row").alias("stands")))
    contents = durable(with_any.join(stands, F.col("row") == F.col("stands"), "left_semi").select("row", "doc_id", "text_key", "buckets", "registers", "shingles"))
    members = durable(contents.select(F.explode("buckets").alias("bucket"), "row"))
    first = durable(_agreeing(central_pairs(members), contents))
    links = _linked(first, contents, docs, similarity)
    labels = components(links)
    labelled = members.join(labels, F.col("row") == F.col("node"), "left").select("bucket", "row", F.coalesce("label", "row").alias("label"), F.lit(0).alias("shingles"))
    rest = _crossing(labelled).drop("n", "all", "shingles").join(contents.select("row", "registers", "shingles"), "row")
    rest = rest.select("bucket", "row", "label", "registers", "shingles")
    links = durable(_rest(rest, links, contents, docs, similarity, together))
    labels = components(links)

    rows_of = sketches.select("row", "doc_id", "shingles", "key", "text_key").join(stands, "key", "left")
    rows_of = rows_of.join(labels, F.col("stands") == F.col("node"), "left").select("row", "doc_id", "shingles", "text_key", F.coalesce("label", "stands", "row").alias("label"))
    rows_of = durable(rows_of)
    least = rows_of.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    first_row = rows_of.join(least, "label").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("row").alias("kept"))
    classes = least.join(first_row, "label", "left")
    out = rows_of.join(classes, "label")
    return out.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("kept")).alias("kept"), "shingles", "text_key")


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those of which another row of the same class stays.

    The rows to drop are told by doc_id and a hash of the text. Rows with the same of both are copies too: of those one stays.
    """
    found = near_duplicates(docs, similarity)
    by_text = found.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"), F.max("shingles").alias("shingles"))
    by_text = durable(by_text.select(F.col("doc_id").alias("its_doc"), F.col("text_key").alias("its_key"), "kept", "n", "shingles"))
    row = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("text_key") == F.col("its_key"))
    gone = few(durable(by_text.where(~F.col("kept")).select("its_doc", "its_key")))
    left = row.join(gone, same, "left_anti")
    again = durable(by_text.where(F.col("kept") & (F.col("n") > 1) & (F.col("shingles") > 0)).select("its_doc", "its_key"))
    if not again.head(1):
        return left.select("row.*")
    again = few(again)
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return left.join(again, same, "left_anti").unionByName(once).select("row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def queries():
    return {"op1_near_duplicates": op1_near_duplicates}

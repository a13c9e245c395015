"""Toxic texts by a linear classifier that is regularised by counterfactuals.

A text's features are its distinct words, the words' beginnings and their n-grams of bytes, hashed. Features that tell the classes apart are
chosen by a chi-square statistic, and their weights are fitted with a penalty on their absolute values, so that few remain. Where a
sentence of a labelled text mentions a group of people, the mention is swapped for other groups, and every change of the score is
penalised: which group a text speaks of must not make it toxic. All mentions of the sampled texts count, and each row of groups that is
mentioned counts as much as another, however often it is.

The model is fitted on the driver, on a bounded sample of labelled texts of each class (``PER_CLASS``, by a hash of the id); the sample has
as many toxic texts as others, so the bias is moved back to the rate of all labelled rows. Scoring sends a few thousand weights
to every task and shuffles nothing.

Cases: a null text is an empty one, and an empty one gets the score of no features; if a document has several labels it is toxic if one
says so; null labels, and labels without a document, teach nothing; without any label the score is 0; repeated rows are scored each;
an empty table gives an empty result; only ``doc_id`` and ``text`` of the documents, ``doc_id`` and ``toxic`` of the labels are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.llm.arrow import Words, crc32_mod, distinct, keep_rows, mix, rows, slices, split_at, strings
from fansieve.session import table

LETTERS = split_at([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)
BUCKETS = 1 << 18
BEGINNINGS, NGRAMS = (3, 4, 5, 6, 7), (5,)
#: Training: labelled texts of each class, features that are kept, texts that a feature must occur in.
PER_CLASS, FEATURES, LEAST = 1500, 4096, 4
#: Weights of the penalties on weights and on score changes by swaps; rounds of fitting.
SPARSE, SWAP, ROUNDS = 1e-4, 1.0, 400
THRESHOLD = 0.3

#: Neutral words for groups of people. Words of one row may stand for each other in a sentence.
GROUPS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("christians", "jews", "muslims", "hindus", "buddhists", "atheists"),
    ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "juden", "muslime", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "juifs", "musulmans", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "judíos", "musulmanes", "hindúes", "budistas"),
)
_MENTION = re.compile(r"\b(" + "|".join(sorted({w for g in GROUPS for w in g}, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Characters that ``LETTERS`` does not split at; characters of sentences whose swaps are compared at a time.
LETTER, SWAPS_AT_ONCE = re.compile(r"[A-Za-z\x80-\U0010ffff]").match, 1 << 20


def word_features(words: Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``some``, bucket) of all features of these words."""
    start, size = words.start[some], words.end[some] - words.start[some]
    of = np.repeat(np.arange(len(some)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at, data = start[of] + place, words.data
    left = size[of] - place
    numbers, found = [np.arange(len(some))], [mix(words.hash[some])]
    value = np.zeros(len(of), np.uint64)
    for n in range(1, max(*BEGINNINGS, *NGRAMS) + 1):
        there = left >= n
        value = value * np.uint64(257) + np.where(there, data[np.minimum(at + n - 1, len(data) - 1)], 0).astype(np.uint64) + np.uint64(1)
        for kind, chosen in ((1, there & (place == 0) if n in BEGINNINGS else None), (2, there if n in NGRAMS else None)):
            if chosen is not None:
                k = np.flatnonzero(chosen)
                numbers.append(of[k])
                found.append(mix(value[k] * np.uint64(64) + np.uint64(4 * n + kind)))
    return np.concatenate(numbers), (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)


def text_features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each pair once; of the buckets for which ``wanted`` is true."""
    words = Words(texts, LETTERS)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept, where, number = distinct(words.hash)
    of, bucket = word_features(words, where)
    if wanted is not None:
        some = wanted[bucket]
        of, bucket = of[some], bucket[some]
        hit = np.zeros(len(kept), bool)
        hit[of] = True
        running = np.flatnonzero(hit[number])
    else:
        running = np.arange(len(number))
    pairs = np.unique(words.doc[running] * len(kept) + number[running])  # each text's distinct words
    doc, word = pairs // len(kept), pairs % len(kept)
    order = np.argsort(of, kind="stable")
    of, bucket = of[order], bucket[order]
    low, high = np.searchsorted(of, word), np.searchsorted(of, word, side="right")
    times = high - low
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    both = np.unique(np.repeat(doc, times) * BUCKETS + bucket[at])
    return both // BUCKETS, both % BUCKETS


class Classifier:
    """A bias and the weights of buckets; most are zero."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray):
        self.bias, self.buckets, self.weights = bias, buckets, weights

    def logits(self, texts: pa.Array) -> np.ndarray:
        wanted, weight = np.zeros(BUCKETS, bool), np.zeros(BUCKETS)
        wanted[self.buckets], weight[self.buckets] = True, self.weights
        out = np.full(len(texts), self.bias)
        for begin, some in slices(texts):
            doc, bucket = text_features(some, wanted)
            out[begin : begin + len(some)] += np.bincount(doc, weight[bucket], minlength=len(some))
        return out


def _mentions(texts: Iterable[str]) -> Iterator[tuple[str, re.Match, int, str]]:
    """(sentence, mention, row of ``GROUPS``, other word of the row) of all mentions of groups in these texts."""
    for text in texts:
        for sentence in _SENTENCE.findall(text):
            for m in _MENTION.finditer(sentence):
                for row, group in enumerate(GROUPS):
                    if m[0].lower() in group:
                        yield from ((sentence, m, row, other) for other in group if other != m[0].lower())


def swaps(texts: list[str], most: int | None = None) -> list[tuple[str, str]]:
    """(sentence, sentence about another group) for the mentions of groups in these texts, or the first ``most``."""
    return [(sentence, sentence[: m.start()] + other + sentence[m.end() :]) for sentence, m, _, other in islice(_mentions(texts), most)]


def weighted_swaps(texts: list[str]) -> tuple[list[tuple[str, int, int, str]], np.ndarray]:
    """The distinct swaps of all mentions as (sentence, begin and end of the mention, other word), and their weights, with a sum of 1.

    Rows of ``GROUPS`` have the same weight in all, and a row's swaps as they are frequent. Swaps of the same word in a sentence have the same
    features, as these are sets, and count as one.
    """
    held: dict[tuple[int, str, str, str], list[int]] = {}
    for sentence, m, row, other in _mentions(texts):
        begin, end = m.span()
        while begin and LETTER(sentence[begin - 1]):
            begin -= 1
        while end < len(sentence) and LETTER(sentence[end]):
            end += 1
        held.setdefault((row, sentence, sentence[begin:end], other), [0, *m.span()])[0] += 1
    rows_ = np.array([row for row, *_ in held], np.int64)
    times = np.array([n for n, *_ in held.values()], float)
    weight = times / np.bincount(rows_, times)[rows_] / len(np.unique(rows_)) if len(times) else times
    return [(sentence, begin, end, other) for (_, sentence, _, other), (_, begin, end) in held.items()], weight


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(examples: list[tuple[int, str]], rate: float) -> Classifier:
    """Fit to (label, text); ``rate`` is the share of toxic rows among all labelled ones."""
    y = np.array([label for label, _ in examples], float)
    if not len(y):
        return Classifier(-np.inf, np.zeros(0, np.int64), np.zeros(0))
    if y.min() == y.max():
        return Classifier(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), np.zeros(0, np.int64), np.zeros(0))
    texts = strings(pa.array([t for _, t in examples], pa.string()))
    in_toxic, in_other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for begin, some in slices(texts):
        doc, bucket = text_features(some)
        toxic = y[begin + doc] > 0
        in_toxic += np.bincount(bucket[toxic], minlength=BUCKETS)
        in_other += np.bincount(bucket[~toxic], minlength=BUCKETS)
    n_toxic, n = y.sum(), len(y)
    both = in_toxic + in_other
    expected = both * n_toxic / n
    spread = np.maximum(expected * (1 - n_toxic / n) * (1 - both / n), 1e-9)
    chi = np.where((both >= min(LEAST, n_toxic)) & (both < n), (in_toxic - expected) ** 2 / spread, 0.0)
    # Features of mentions are always there, for the swaps to act on.
    pairs, pair_weight = weighted_swaps([t for _, t in examples])
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = chosen[chi[chosen] > 3.84]
    if pairs:
        _, mentions = text_features(strings(pa.array([w for g in GROUPS for w in g])))
        chosen = np.union1d(chosen, mentions)
    buckets = np.sort(chosen)
    wanted = np.zeros(BUCKETS, bool)
    wanted[buckets] = True

    def matrix(some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        docs, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, part in slices(some):
            doc, bucket = text_features(part, wanted)
            docs.append(doc + begin)
            columns.append(np.searchsorted(buckets, bucket))
        return np.concatenate(docs), np.concatenate(columns)

    doc, column = matrix(texts)
    k, m = len(buckets), max(1, len(pairs))
    # What a swap takes from the features and what it adds; those on both sides change nothing.
    parts, block, held = [], [], 0

    def add(end: int) -> None:
        before, after = (np.stack(matrix(strings(pa.array([pair[side] for pair in block], pa.string())))) for side in (0, 1))
        before, after = before[0] * k + before[1], after[0] * k + after[1]
        for sign, here, there in ((1.0, before, after), (-1.0, after, before)):
            only = np.setdiff1d(here, there)
            parts.append((only // k + end - len(block), only % k, np.full(len(only), sign)))
        block.clear()

    for i, (sentence, begin, end, other) in enumerate(pairs):
        block.append((sentence, sentence[:begin] + other + sentence[end:]))
        held += len(sentence)
        if held >= SWAPS_AT_ONCE or i + 1 == len(pairs):
            add(i + 1)
            held = 0
    pair, changed, sign = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    weight, bias, momentum, moved = np.zeros(k), 0.0, np.zeros(k), 1.0

    def swapped(w: np.ndarray) -> np.ndarray:
        """The gradient of the penalty on changes of the score."""
        change = pair_weight * np.bincount(pair, sign * w[changed], minlength=m)
        return 2 * SWAP * np.bincount(changed, sign * change[pair], minlength=k)

    # The step is that of the steepest direction, found by power iterations.
    v = np.ones(k) / np.sqrt(max(1, k))
    size = 1.0
    for _ in range(20):
        v = 0.25 * np.bincount(column, np.bincount(doc, v[column], minlength=n)[doc], minlength=k) / n + (swapped(v) if pairs else 0.0)
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (1.1 * size + 0.3)
    ahead, ahead_bias, old_bias = weight.copy(), 0.0, 0.0
    for _ in range(ROUNDS):
        p = _sigmoid(np.bincount(doc, ahead[column], minlength=n) + ahead_bias)
        off = (p - y) / n
        gradient = np.bincount(column, off[doc], minlength=k)
        if pairs:
            gradient += swapped(ahead)
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * SPARSE, 0)
        bias = ahead_bias - step * off.sum()
        then = (1 + np.sqrt(1 + 4 * moved * moved)) / 2
        ahead, ahead_bias = new + (moved - 1) / then * (new - weight), bias + (moved - 1) / then * (bias - old_bias)
        weight, old_bias, moved = new, bias, then
    here = n_toxic / n
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    bias += np.log(rate / (1 - rate)) - np.log(here / (1 - here))
    return Classifier(float(bias), buckets[weight != 0], weight[weight != 0])


def _held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def fit(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, per_class: int = PER_CLASS) -> Classifier:
    """Fit to a bounded sample of the labelled documents that are not held out. Only the chosen ids meet the texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], 0.0)
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 53)) / float(1 << 53)
    chance = F.when(F.col("toxic") > 0, min(1.0, 1.2 * per_class / counts.get(1, 1))).otherwise(min(1.0, 1.2 * per_class / counts.get(0, 1)))
    chosen = known.where(place < chance).select(F.col("doc_id").alias("its_doc"), (F.col("toxic") > 0).cast("int").alias("toxic"), place.alias("place"))
    chosen = F.broadcast(chosen.orderBy("place").limit(3 * per_class))
    rows_ = docs.join(chosen, F.col("doc_id") == F.col("its_doc")).select("toxic", "place", "text").limit(3 * per_class).collect()
    rows_.sort(key=lambda r: (r["place"], r["text"] or ""))
    return train([(r["toxic"], r["text"] or "") for r in rows_], counts.get(1, 0) / sum(counts.values()))


def toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, as in op10.

    ``training(doc_id, text)`` with ``labels(doc_id, toxic)`` is what may be learned from, but for documents with
    ``crc32(doc_id) % modulus = remainder``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training.select("doc_id", "text"), labels.select("doc_id", "toxic"), modulus, remainder))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            schema = pa.schema([("doc_id", ids.type), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
            score = _sigmoid(model.value.logits(strings(batch.column("text"))))
            yield rows(schema, doc_id=ids, held_out=crc32_mod(ids.to_pylist(), modulus) == remainder, score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold; learned from those of them that have labels."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), modulus, remainder))

    return keep_rows(docs, lambda texts: _sigmoid(model.value.logits(texts)) < THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))


def queries():
    return {"op10_toxicity": op10_toxicity}

"""Languages of words and of whole texts by a linear-chain conditional random field.

Every word of a text gets a label. What speaks for a label are the word's affixes, the n-grams of its bytes and its place in a learned lexicon; how
likely a label is after another is learned too, so that a text may change its language on the way. Forward-backward gives the
probability of every label at every word. A text's language is the one with the most words, by these probabilities; its score is the share of its words.

The field is trained on the driver, on a bounded sample of labelled texts of each language (``PER_LANGUAGE``, by a hash of the id). Labels are
known for texts only, so training sequences are put together from pieces of texts of different languages: these are the switches that it learns from.

Cases: a null text, and one without a letter, is ``und`` with score 0; without labelled training texts all are; text of any length is read
whole; repeated rows are labelled each; an empty table gives an empty result; only ``doc_id``, ``text`` and ``lang`` are read, ``lang`` of
training texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.llm.arrow import Split, Words, crc32_mod, distinct, keep_rows, mix, rows, slices, split_at, strings
from fansieve.llm.sampling import bounded_classes
from fansieve.session import table

#: Words are runs of letters: a-z (A-Z before) and everything beyond ASCII.
LETTERS: Split = split_at([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)
BUCKETS = 1 << 16
NGRAMS, AFFIXES = (2, 3, 4), (1, 2, 3)
#: Training: texts of each language, words in a piece of one language (mean), in a sequence, sequences at a time.
PER_LANGUAGE, PIECE, SEQUENCE, AT_ONCE, PASSES, STEP, RIDGE = 100, 25, 128, 64, 3, 0.05, 1e-5
#: A word is in the lexicon if it occurs so often in the training words.
LEXICON_COUNT = 4
#: Bytes of text that are labelled together, and distinct words whose features are held at a time.
SLICE, WORDS_AT_ONCE = 3 << 20, 1 << 14
UNKNOWN = "und"
#: A text with less of its words in one language is of none.
LEAST_SHARE = 0.5


def features(words: Words, some: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``some``, bucket) of all features of these words."""
    start, size = words.start[some], words.end[some] - words.start[some]
    of = np.repeat(np.arange(len(some)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(of)) - begin[of]
    at = start[of] + place
    left = size[of] - place
    data = words.data
    numbers, buckets, value = [], [], np.zeros(len(of), np.uint64)
    for n in range(1, max(NGRAMS[-1], AFFIXES[-1]) + 1):
        there = left >= n
        value = value * np.uint64(257) + np.where(there, data[np.minimum(at + n - 1, len(data) - 1)], 0).astype(np.uint64) + np.uint64(1)
        for kind, chosen in ((1, there if n in NGRAMS else None), (2, there & (place == 0) if n in AFFIXES else None), (3, left == n if n in AFFIXES else None)):
            if chosen is not None:
                k = np.flatnonzero(chosen)
                numbers.append(of[k])
                buckets.append(mix(value[k] * np.uint64(64) + np.uint64(8 * n + kind)) % np.uint64(BUCKETS))
    h = words.hash[some]
    if len(lexicon):
        known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h)
        numbers.append(known)
        buckets.append(mix(h[known] ^ np.uint64(0x1E71C0)) % np.uint64(BUCKETS))
    return np.concatenate(numbers), np.concatenate(buckets).astype(np.int64)


class Field:
    """Weights of features by label, of a label after another, and of the first label."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weight = np.zeros((BUCKETS, n), np.float32)
        self.move, self.begin = np.zeros((n, n)), np.zeros(n)

    def evidence(self, numbers: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """For each word and label the exponential of the summed weights, scaled so that the largest is 1."""
        total = np.stack([np.bincount(numbers, self.weight[buckets, k], minlength=n) for k in range(len(self.labels))], axis=1)
        return np.exp(total - total.max(axis=1, keepdims=True)) + 1e-30

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(self.move - self.move.max()), np.exp(self.begin - self.begin.max())


def marginals(evidence: np.ndarray, word: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return forward_backward(evidence, word, first, size, move, begin)[0]


def forward_backward(
    evidence: np.ndarray, word: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each label at each running word, over many sequences side by side; if ``pairs``, also how many moves from label to label are expected.

    Sequence i is ``word[first[i]:first[i] + size[i]]``, numbers of rows of ``evidence``; sequences come longest first.
    """
    out, moved = np.zeros((len(word), evidence.shape[1])), np.zeros_like(move)
    longest = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences with more than t words
    a = None
    for t in range(longest):
        at = first[: going[t]] + t
        a = (begin if a is None else a[: going[t]] @ move) * evidence[word[at]]
        a /= a.sum(axis=1, keepdims=True)
        out[at] = a
    b = np.ones((0, evidence.shape[1]))
    for t in range(longest - 1, -1, -1):
        n = going[t]
        if len(b) < n:
            b = np.concatenate([b, np.ones((n - len(b), evidence.shape[1]))])
        at = first[:n] + t
        out[at] *= b
        b = evidence[word[at]] * b
        if pairs and t:
            # Where the word before stands, only what lies before it is known so far.
            both = out[at - 1][:, :, None] * move * b[:, None, :]
            moved += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ move.T
        b /= b.sum(axis=1, keepdims=True)
    out /= out.sum(axis=1, keepdims=True)
    return out, moved


def train(examples: list[tuple[str, str]], seed: int = 3) -> Field:
    """Fit a field to (language, text) by gradient ascent on the likelihood of code-switched sequences."""
    labels = sorted({lang for lang, _ in examples})
    r = np.random.default_rng(seed)
    if not examples:
        return Field([], np.zeros(0, np.uint64))
    examples = [examples[i] for i in r.permutation(len(examples))]
    words = Words(strings(pa.array([t for _, t in examples], pa.string())), LETTERS)
    kept, where, number = distinct(words.hash)
    field = Field(labels, kept[np.bincount(number, minlength=len(kept)) >= LEXICON_COUNT])
    if not len(kept):
        return field
    # Pieces of texts in random order.
    label_of = np.array([labels.index(lang) for lang, _ in examples])
    pieces = []
    for d in range(len(examples)):
        at = words.first[d]
        while at < words.first[d + 1]:
            end = min(words.first[d + 1], at + 1 + r.geometric(1 / PIECE))
            pieces.append((d, at, end))
            at = end
    order = r.permutation(len(pieces))
    running = np.concatenate([number[pieces[i][1] : pieces[i][2]] for i in order])
    truth = np.concatenate([np.full(pieces[i][2] - pieces[i][1], label_of[pieces[i][0]]) for i in order])
    # Sequences of one length; the last has what is left.
    n, first = len(labels), np.arange(0, len(running), SEQUENCE)
    sizes = np.diff(np.append(first, len(running)))
    numbers, buckets = features(words, where, field.lexicon)
    by_word = np.argsort(numbers, kind="stable")
    numbers, buckets = numbers[by_word], buckets[by_word]
    edge = np.searchsorted(numbers, np.arange(len(kept) + 1))
    square = np.zeros_like(field.weight) + 1e-8
    turn = 0
    for _ in range(PASSES):
        for chosen in np.array_split(r.permutation(len(first)), max(1, len(first) // AT_ONCE)):
            turn += 1
            chosen = chosen[np.argsort(-sizes[chosen], kind="stable")]
            size = sizes[chosen]
            at = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in chosen])
            start = np.cumsum(size) - size
            here, word = np.unique(running[at], return_inverse=True)
            counts = edge[here + 1] - edge[here]
            of = np.repeat(np.arange(len(here)), counts)
            bucket = buckets[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(edge[here], counts)]
            evidence = field.evidence(of, bucket, len(here))
            move, begin = field.moves()
            p, moved = forward_backward(evidence, word, start, size, move, begin, pairs=True)
            want = np.eye(n)[truth[at]]
            off = want - p
            # Words to features, and Adagrad steps.
            by_here = np.stack([np.bincount(word, off[:, k], minlength=len(here)) for k in range(n)], axis=1)
            step = np.stack([np.bincount(bucket, by_here[of, k], minlength=BUCKETS) for k in range(n)], axis=1).astype(np.float32) / SEQUENCE
            step -= RIDGE * field.weight
            square += step * step
            field.weight += STEP * 4 * step / np.sqrt(square)
            # Moves that are there less those expected, per move.
            inside = np.delete(np.arange(len(at)), start)
            seen = np.zeros((n, n))
            np.add.at(seen, (truth[at[inside] - 1], truth[at[inside]]), 1)
            field.move += 8.0 * (seen - moved) / max(len(inside), 1)
            field.begin += 0.5 * off[start].mean(axis=0)
    return field


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def label_texts(field: Field, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text: language, score, words, and how often the most likely label changes from a word to the next."""
    words = Words(texts, LETTERS)
    _, where, number = distinct(words.hash)
    size = words.counts
    order = np.argsort(-size, kind="stable")
    n, changes = len(field.labels), np.zeros(len(texts), np.int64)
    share = np.zeros((len(texts), n))
    if n and len(number):
        some = [where[k : k + WORDS_AT_ONCE] for k in range(0, len(where), WORDS_AT_ONCE)]
        evidence = np.concatenate([field.evidence(*features(words, w, field.lexicon), len(w)) for w in some])
        p = marginals(evidence, number, words.first[:-1][order], size[order], *field.moves())
        best = p.argmax(axis=1)
        changes = np.bincount(words.doc[1:][(best[1:] != best[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=len(texts))
        for k in range(n):
            share[:, k] = np.bincount(words.doc, p[:, k], minlength=len(texts)) / np.maximum(size, 1)
    top = share.argmax(axis=1) if n else np.zeros(len(texts), np.int64)
    langs, score = [], np.zeros(len(texts))
    plain = np.zeros(len(texts), bool)  # texts with a letter a-z
    ascii_letter = (words.data[words.start] >= 97) & (words.data[words.start] <= 122) if len(words.start) else np.zeros(0, bool)
    plain[words.doc[ascii_letter]] = True
    for i in range(len(texts)):
        if n and size[i] and (plain[i] or _has_letter(texts[i].as_py())):
            langs.append(field.labels[top[i]])
            score[i] = min(1.0, share[i, top[i]])
        else:
            langs.append(UNKNOWN)
    return langs, score, size, changes


def _fit(training: DataFrame, modulus: int, remainder: int):
    """The field, sent to all tasks."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
    examples = bounded_classes(training.select("doc_id", "text", "lang").where(~held_out), "lang", PER_LANGUAGE)
    return training.sparkSession.sparkContext.broadcast(train(examples))


def identify(docs: DataFrame, training: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, as in op3; also ``words`` and ``switches``, changes of language between words.

    ``training(doc_id, text, lang)`` is what may be learned from; of it, documents with ``crc32(doc_id) % modulus = remainder`` are left out.
    """
    field = _fit(training, modulus, remainder)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            schema = pa.schema(
                [("doc_id", ids.type), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("words", pa.int64()), ("switches", pa.int64())]
            )
            for begin, some in slices(strings(batch.column("text")), SLICE):
                here = ids.slice(begin, len(some))
                langs, score, size, changes = label_texts(field.value, some)
                yield rows(schema, doc_id=here, held_out=crc32_mod(here.to_pylist(), modulus) == remainder, lang_pred=langs, score=score, words=size, switches=changes)

    kind = f"doc_id {id_type}, held_out boolean, lang_pred string, score double, words long, switches long"
    return docs.select("doc_id", "text").mapInArrow(task, kind)


def with_language(docs: DataFrame, least: float = LEAST_SHARE, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """The rows of ``docs`` of which at least this share of words is in one language; learned from those of them that have one."""
    field = _fit(docs, modulus, remainder)

    def keep(texts: pa.Array) -> np.ndarray:
        langs, score, _, _ = label_texts(field.value, texts)
        return (np.array(langs) != UNKNOWN) & (score >= least)

    return keep_rows(docs, keep, SLICE)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, docs)


def queries():
    return {"op3_language_id": op3_language_id}

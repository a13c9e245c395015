"""Scores of whole texts by a gated recurrent language model with a class-factored output.

The vocabulary is counted over all training texts. Its words fall into classes: the ``FREQUENT`` most frequent ones, in groups of
``CLASS_SIZE``; words of the head of the vocabulary, by how often they occur; and one class for the tail and words never seen. The
probability of a word is that of its class, a softmax of the recurrent state, times that of the word in its class: a softmax of the
state too for frequent words, else proportional to its count plus one. So every word has a probability, and all those of a
vocabulary with one unseen word sum to one.

The network learns from all training texts, where they are. In each of ``ROUNDS`` rounds every task starts from the same weights and runs truncated
backpropagation over its texts of that round, so each text is learned from once (of a small corpus, several times). It returns sums of
a fixed size: its weights times how many tokens spoke for them, and these numbers. They are added up in a tree and the next round begins from the averages. Inputs and classes have
numbers of their own, so what occurs in a few tasks only is averaged over these. No text reaches the driver. Texts are scored window by window; the state is
zero where a text begins, in training and in scoring, and goes on from one window to the next until its end, so a score is that of the whole text.

Only the head of the vocabulary, of a fixed size, is sent to every task. The words beyond it leave the task as hashes and meet their counts
in a join, in which no word is frequent, so no key is hot. Words are told apart by 64-bit hashes.

Cases: a null text is an empty one and has only its end token; a null id counts as the empty text for the split; no training texts, or an
empty table, leave an untrained network with even classes; repeated rows are scored each; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.llm.arrow import BY_WHITE_LOWER, Words, crc32_mod, distinct, rows, slices, strings
from fansieve.session import durable, table

#: Words whose place in their class is learned, how many are in such a class, and words whose counts every task has.
FREQUENT, CLASS_SIZE, HEAD = 512, 32, 1 << 18
#: Size of the state, of the inputs, and of a window of training and of scoring.
STATE, INPUT, TRAIN_WINDOW, SCORE_WINDOW = 16, 16, 16, 24
#: Training: rounds, parallel streams and the tokens that make one, tokens that are laid out in streams together, step size.
ROUNDS, STREAMS, STREAM_TOKENS, LAID_OUT, STEP = 3, 256, 2048, 1 << 20, 8e-3
#: A corpus of fewer tokens is gone over several times, at most so many.
LEAST_TOKENS, PASSES = 3_000_000, 6
#: Tasks whose sums are added up in one.
TREE = 32
#: The end of a text, as a token of its own: no word has this hash by its making from bytes.
END = np.uint64(0xE0D)


@dataclass
class Vocabulary:
    """The head of the vocabulary and what is known of the rest: ``hashes`` ascending, with ``counts`` and ``place`` by frequency."""

    hashes: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    tokens: int
    types: int

    def __post_init__(self):
        n = len(self.hashes)
        self.frequent = min(FREQUENT, n)
        self.learned = -(-self.frequent // CLASS_SIZE)
        self.word_class = np.empty(n + 1, np.int64)
        common = self.place < self.frequent
        bins = np.log2(np.maximum(self.counts, 1)).astype(np.int64) // 2
        low = bins[~common].min() if (~common).any() else 0
        high = bins[~common].max() if (~common).any() else -1
        self.word_class[:n] = np.where(common, self.place // CLASS_SIZE, self.learned + (high - bins))
        self.bins = int(high - low + 1)
        self.rest = self.learned + self.bins  # the class of the tail
        self.word_class[n] = self.rest
        self.classes = self.rest + 1
        mass = np.bincount(self.word_class[:n], weights=self.counts + 1.0, minlength=self.classes)
        mass[self.rest] += self.tokens + self.types + 1 - (self.counts + 1).sum()
        self.log_mass = np.log(np.maximum(mass, 1.0))
        # Inputs: a frequent word has its own, others that of their class.
        self.inputs = self.frequent + self.bins + 2
        own = np.append(self.place, n)
        self.word_input = np.where(own < self.frequent, own, self.frequent + np.minimum(self.word_class - self.learned, self.bins) % (self.bins + 1))
        self.start = self.inputs - 1  # what comes before the first word
        self.log_count = np.append(np.log(self.counts + 1.0), 0.0)

    def index(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the head, or the number of words in it."""
        n = len(self.hashes)
        if n == 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), n - 1)
        return np.where(self.hashes[at] == h, at, n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Network:
    """A gated recurrent unit, a softmax over classes, and one over the words of each learned class."""

    NAMES = ("embed", "wx", "bx", "wh", "wc", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, v: Vocabulary, seed: int = 7):
        r = np.random.default_rng(seed)

        def some(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.embed = some(v.inputs, INPUT, scale=0.3)
        self.wx, self.bx = some(INPUT, 3 * STATE, scale=0.25), np.zeros(3 * STATE, np.float32)
        self.wh, self.wc = some(STATE, 2 * STATE, scale=0.25), some(STATE, STATE, scale=0.25)
        self.class_w, self.class_b = some(STATE, v.classes, scale=0.1), np.zeros(v.classes, np.float32)
        self.word_w = some(max(1, v.learned), STATE, CLASS_SIZE, scale=0.1)
        self.word_b = np.zeros((max(1, v.learned), CLASS_SIZE), np.float32)
        # The last class may have fewer words.
        if v.frequent % CLASS_SIZE:
            self.word_b[v.learned - 1, v.frequent % CLASS_SIZE :] = -1e4
        by_class = np.bincount(v.word_class[:-1], weights=v.counts.astype(float), minlength=v.classes)
        by_class[v.rest] += max(0, v.tokens - v.counts.sum())
        self.class_b += np.log((by_class + 1) / (by_class + 1).sum()).astype(np.float32)
        for c in range(v.learned):
            inside = np.flatnonzero(v.place // CLASS_SIZE == c)
            inside = inside[v.place[inside] < v.frequent]
            self.word_b[c, v.place[inside] % CLASS_SIZE] = np.log(v.counts[inside] + 1.0)

    def projected(self) -> np.ndarray:
        """What each input adds to the three gates."""
        return self.embed @ self.wx + self.bx

    def step(self, gates: np.ndarray, h: np.ndarray):
        """The next state from the inputs' part of the gates and the state; also what the backward pass needs."""
        zr = _sigmoid(gates[:, : 2 * STATE] + h @ self.wh)
        z, r = zr[:, :STATE], zr[:, STATE:]
        rh = r * h
        c = np.tanh(gates[:, 2 * STATE :] + rh @ self.wc)
        return h + z * (c - h), (zr, rh, c)

    def log_probability(self, v: Vocabulary, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithm for words in the head, by the state before each; for others, that of their class alone."""
        classes = v.word_class[word]
        out = _log_softmax(h @ self.class_w + self.class_b)[np.arange(len(word)), classes].astype(np.float64)
        plain = classes >= v.learned
        out[plain] -= v.log_mass[classes[plain]] - v.log_count[word[plain]]
        of = np.flatnonzero(~plain)
        of = of[np.argsort(classes[of], kind="stable")]
        edges = np.searchsorted(classes[of], np.arange(v.learned + 1))
        for c in range(v.learned):
            some = of[edges[c] : edges[c + 1]]
            if len(some):
                inside = _log_softmax(h[some] @ self.word_w[c] + self.word_b[c])
                out[some] += inside[np.arange(len(some)), v.place[word[some]] % CLASS_SIZE]
        return out

    def gradients(self, v: Vocabulary, before: np.ndarray, word: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """One window of streams [time, stream]: gradients of the mean loss, the state at its end, the loss. Where ``fresh``, a text begins."""
        table, steps, streams = self.projected(), *word.shape
        gates, goes_on = table[before], (~fresh)[:, :, None].astype(h.dtype)
        old, state, zr, rh, c = (np.empty((steps, streams, size), h.dtype) for size in (STATE, STATE, 2 * STATE, STATE, STATE))
        for t in range(steps):
            old[t] = h * goes_on[t]
            h, (zr[t], rh[t], c[t]) = self.step(gates[t], old[t])
            state[t] = h
        total = steps * streams
        flat, target = state.reshape(total, STATE), word.ravel()
        classes = v.word_class[target]
        g = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        log_p = _log_softmax(flat @ self.class_w + self.class_b)
        loss = -log_p[np.arange(total), classes].sum()
        d = np.exp(log_p)
        d[np.arange(total), classes] -= 1
        g["class_w"], g["class_b"] = flat.T @ d, d.sum(axis=0)
        d_flat = d @ self.class_w.T
        by_class = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[by_class], np.arange(v.learned + 1))
        for k in range(v.learned):
            some = by_class[edges[k] : edges[k + 1]]
            if len(some):
                these = flat[some]
                inside, place = _log_softmax(these @ self.word_w[k] + self.word_b[k]), v.place[target[some]] % CLASS_SIZE
                row = np.arange(len(some))
                loss -= inside[row, place].sum()
                d = np.exp(inside)
                d[row, place] -= 1
                g["word_w"][k], g["word_b"][k] = these.T @ d, d.sum(axis=0)
                d_flat[some] += d @ self.word_w[k].T
        # What does not depend on later steps is worked out for all of them at once.
        z, r = zr[:, :, :STATE], zr[:, :, STATE:]
        by_c, by_z, by_r, stays = z * (1 - c * c), (c - old) * z * (1 - z), old * r * (1 - r), 1 - z
        d_flat, d_h = d_flat.reshape(steps, streams, STATE), np.zeros_like(h)
        d_gates = np.empty((steps, streams, 3 * STATE), h.dtype)
        for t in range(steps - 1, -1, -1):
            d_h += d_flat[t]
            d = d_gates[t]
            np.multiply(d_h, by_c[t], out=d[:, 2 * STATE :])
            d_rh = d[:, 2 * STATE :] @ self.wc.T
            np.multiply(d_h, by_z[t], out=d[:, :STATE])
            np.multiply(d_rh, by_r[t], out=d[:, STATE : 2 * STATE])
            d_h *= stays[t]
            d_h += d_rh * r[t]
            d_h += d[:, : 2 * STATE] @ self.wh.T
            d_h *= goes_on[t]
        d_gates = d_gates.reshape(total, -1)
        g["wc"] = rh.reshape(total, -1).T @ d_gates[:, 2 * STATE :]
        g["wh"] = old.reshape(total, -1).T @ d_gates[:, : 2 * STATE]
        at = before.ravel()
        inputs, d_inputs = self.embed[at], d_gates @ self.wx.T
        g["wx"], g["bx"] = inputs.T @ d_gates, d_gates.sum(axis=0)
        g["embed"] = np.stack([np.bincount(at, d_inputs[:, k], minlength=v.inputs) for k in range(INPUT)], axis=1).astype(d_inputs.dtype)
        return {k: x / np.float32(total) for k, x in g.items()}, h, float(loss / total)


class Learner:
    """Trains a network on running words by truncated backpropagation with Adam, and counts what spoke for which weights."""

    def __init__(self, v: Vocabulary, net: Network, step: float = STEP):
        self.v, self.net, self.rate, self.n = v, net, step, 0
        self.first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
        self.second = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
        self.tokens, self.by_input, self.by_class = 0, np.zeros(v.inputs), np.zeros(v.classes)

    def feed(self, word: np.ndarray) -> None:
        """Learn from running words (numbers in the head; texts end in the end token), all of them, in streams side by side."""
        if not len(word):
            return
        v = self.v
        end = v.index(np.array([END]))[0]
        fresh = np.concatenate([[True], word[:-1] == end])
        before = np.where(fresh, v.start, np.concatenate([[v.start], v.word_input[word[:-1]]]))
        self.tokens += len(word)
        self.by_input += np.bincount(before, minlength=v.inputs)
        self.by_class += np.bincount(v.word_class[word], minlength=v.classes)
        # Few tokens make few streams, so that there are enough steps.
        streams = max(1, min(STREAMS, max(32, len(word) // STREAM_TOKENS), len(word) // (2 * TRAIN_WINDOW)))
        whole = len(word) // streams * streams
        for part, width in ((slice(0, whole), streams), (slice(whole, None), 1)):
            columns = [x[part].reshape(width, -1).T for x in (before, word, fresh)]
            h = np.zeros((width, STATE), np.float32)
            for b in range(0, len(columns[0]), TRAIN_WINDOW):
                g, h, _ = self.net.gradients(v, *(x[b : b + TRAIN_WINDOW] for x in columns[:2]), h, columns[2][b : b + TRAIN_WINDOW])
                self._step(g)

    def _step(self, g: dict) -> None:
        self.n += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
            self.first[k] = 0.9 * self.first[k] + 0.1 * x
            self.second[k] = 0.99 * self.second[k] + 0.01 * x * x
            move = self.rate * (self.first[k] / (1 - 0.9**self.n)) / (np.sqrt(self.second[k] / (1 - 0.99**self.n)) + 1e-8)
            setattr(self.net, k, (getattr(self.net, k) - move).astype(np.float32))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights times what spoke for them, and this, each as one array."""
        learned = self.by_class[: max(1, self.v.learned)]
        own = {"embed": self.by_input[:, None], "word_w": learned[:, None, None], "word_b": learned[:, None]}
        spoke = [np.broadcast_to(own.get(k, float(self.tokens)), getattr(self.net, k).shape).ravel() for k in self.net.NAMES]
        return np.concatenate([getattr(self.net, k).ravel() * w for k, w in zip(self.net.NAMES, spoke, strict=True)]), np.concatenate(spoke)


def averaged(net: Network, weighted: np.ndarray, spoke: np.ndarray) -> Network:
    """The network of the averages; what nothing spoke for stays."""
    at = 0
    for k in net.NAMES:
        old = getattr(net, k)
        some = slice(at, at + old.size)
        at += old.size
        new = np.where(spoke[some] > 0, weighted[some] / np.maximum(spoke[some], 1), old.ravel())
        setattr(net, k, new.reshape(old.shape).astype(np.float32))
    return net


def train(docs: DataFrame, v: Vocabulary, modulus: int, remainder: int, rounds: int = ROUNDS) -> Network:
    """Fit a network to all training texts of ``docs(doc_id, text)``, see the head of the module."""
    spark, net = docs.sparkSession, Network(v)
    if not v.tokens:
        return net
    passes = max(1, min(PASSES, round(LEAST_TOKENS / v.tokens)))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((v, net))
        rate = STEP * (1 - turn / rounds)

        def task(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            from copy import deepcopy

            from pyspark import TaskContext

            v, net = sent.value
            learner, waiting, size = Learner(v, deepcopy(net), rate), [], 0

            def learn() -> None:
                word = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
                for _ in range(passes):
                    learner.feed(word)

            for batch in batches:
                number = crc32_mod(batch.column("doc_id").to_pylist(), modulus * rounds)
                here = (number % modulus != remainder) & (number // modulus == turn)
                for _, some in slices(strings(batch.column("text")).filter(pa.array(here))):
                    h, _ = _tokens(Words(some, BY_WHITE_LOWER))
                    waiting.append(v.index(h).astype(np.int32))
                    size += len(h)
                    if size >= LAID_OUT:
                        learn()
                        waiting, size = [], 0
            learn()
            if learner.tokens:
                sums = [[x.astype("<f8").tobytes()] for x in learner.sums()]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array(x, pa.binary()) for x in sums)], names=["slot", "weighted", "spoke"])

        kind = "slot long, weighted binary, spoke binary"
        sums = durable(docs.select("doc_id", "text").mapInArrow(task, kind))

        def add(held: pa.Table) -> pa.Table:
            # In one order: sums of the same numbers are then the same in every run.
            held = held.sort_by("slot")
            total = [sum(np.frombuffer(x, "<f8") for x in held.column(c).to_pylist()).tobytes() for c in ("weighted", "spoke")]
            return pa.table({"slot": held.column("slot").slice(0, 1), "weighted": pa.array([total[0]], pa.binary()), "spoke": pa.array([total[1]], pa.binary())})

        span = TREE
        while sums.count() > TREE:
            sums = durable(sums.groupBy(F.floor(F.col("slot") / span)).applyInArrow(add, kind))
            span *= TREE
        last = sums.orderBy("slot").collect()
        if last:
            net = averaged(net, *(sum(np.frombuffer(r[c], "<f8") for r in last) for c in ("weighted", "spoke")))
        sent.unpersist()
    return net


def score_texts(net: Network, v: Vocabulary, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The natural log-likelihood of each text, but for its words' places in the tail class.

    Text i is ``word[first[i]:first[i + 1]]``, its end token included. Texts run side by side, longest first; window after window the state
    is kept, and texts drop out where they end.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    out, table = np.zeros(len(order)), net.projected()
    h = np.zeros((len(order), STATE), np.float32)
    before = np.full(len(order), v.start)
    for t in range(0, int(size[0]) if len(size) else 0, SCORE_WINDOW):
        states, words, of = [], [], []
        for s in range(t, min(t + SCORE_WINDOW, int(size[0]))):
            n = int(np.searchsorted(-size, -s, side="left"))  # texts with more than s tokens
            h, before = h[:n], before[:n]
            h, _ = net.step(table[before], h)
            now = word[begin[:n] + s]
            states.append(h)
            words.append(now)
            of.append(n)
            before = v.word_input[now]
        log_p = net.log_probability(v, np.concatenate(states), np.concatenate(words))
        at = 0
        for n in of:
            out[:n] += log_p[at : at + n]
            at += n
    result = np.empty(len(order))
    result[order] = out
    return result


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens, and where each text begins; one more entry for the end."""
    ends = words.first[1:]
    return np.insert(words.hash, ends, END), np.concatenate([[0], ends + np.arange(1, words.n_docs + 1)])


def _held_out(ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    return crc32_mod(ids.to_pylist(), modulus) == remainder


def count_words(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """``(word, n)`` over the training texts, words as hashes; counted in the task first, a batch at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learns = pa.array(~_held_out(batch.column("doc_id"), modulus, remainder))
            words, counts = [], []
            for _, some in slices(strings(batch.column("text")).filter(learns)):
                h, _ = _tokens(Words(some, BY_WHITE_LOWER))
                kept, _, number = distinct(h)
                words.append(kept)
                counts.append(np.bincount(number, minlength=len(kept)))
            if words:
                kept, _, number = distinct(np.concatenate(words))
                n = np.bincount(number, weights=np.concatenate(counts), minlength=len(kept)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """At most ``head`` words reach the driver, the most frequent ones, and a histogram of how often words occur.

    The histogram has a bar for each eighth of a power of two; the head is made of whole bars, so no words need be sorted or ranked.
    Words that occur once are never in it: they teach the network where words that it has never seen stand.
    """
    bar = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    bars = counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("bar")).collect()
    total, types, least, kept = sum(b["n"] for b in bars), sum(b["words"] for b in bars), None, 0
    for b in bars:
        kept += b["words"]
        if kept > head or b["bar"] == 0:
            break
        least = b["bar"]
    most = counts.where(bar >= least if least is not None else F.lit(False)).toArrow()
    word, n = most.column("word").to_numpy().view(np.uint64), most.column("n").to_numpy()
    by_count = np.lexsort((word, -n))
    word, n = word[by_count], n[by_count]
    order = np.argsort(word)
    place = np.arange(len(word))[order]
    return Vocabulary(word[order], n[order].astype(np.int64), place, total, types)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, as in op7. Documents with ``crc32(doc_id) % modulus = remainder`` are held out."""
    spark = docs.sparkSession
    counts = durable(count_words(docs, modulus, remainder))
    v = vocabulary(counts)
    net = train(docs, v, modulus, remainder)
    sent = spark.sparkContext.broadcast((v, net))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, net = sent.value
        number, n_head = TaskContext.get().partitionId() << 40, len(v.hashes)
        for batch in batches:
            ids = batch.column("doc_id")
            schema = pa.schema(
                [("row", pa.int64()), ("doc_id", ids.type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                 ("head", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.int64()))]
            )
            word, first, tails, tail_at, base, known = [], [0], [], [0], [], []
            for _, some in slices(strings(batch.column("text"))):
                h, at = _tokens(Words(some, BY_WHITE_LOWER))
                w = v.index(h)
                beyond = w == n_head
                base.append(np.add.reduceat(v.log_count[w], at[:-1]))
                outside = np.add.reduceat(beyond.astype(np.int64), at[:-1])
                known.append(np.diff(at) - outside)
                tails.append(h[beyond])
                tail_at.extend((tail_at[-1] + np.cumsum(outside)).tolist())
                word.append(w.astype(np.int32))
                first.extend((first[-1] + at[1:]).tolist())
            n = len(ids)
            if n == 0:
                continue
            first = np.array(first)
            yield rows(
                schema, row=np.arange(number, number + n), doc_id=ids, held_out=_held_out(ids, modulus, remainder), n_tokens=np.diff(first), n_known=np.concatenate(known),
                head=np.concatenate(base), model=score_texts(net, v, np.concatenate(word), first),
                tail=pa.ListArray.from_arrays(pa.array(tail_at, pa.int32()), pa.array(np.concatenate(tails).view(np.int64))),
            )
            number += n

    kind = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, head double, model double, tail array<long>"
    scored = durable(docs.select("doc_id", "text").mapInArrow(task, kind))
    known = F.when(F.col("n").isNotNull(), 1).otherwise(0)
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log(F.coalesce(F.col("n"), F.lit(0)) + 1.0)).alias("tail_log"), F.sum(known).alias("tail_known"), F.count("*").alias("tail_n"))
    out = scored.drop("tail").join(tail, "row", "left").na.fill(0, ["tail_log", "tail_known", "tail_n"])
    log_10 = float(np.log(10.0))
    all_mass = float(np.log10(v.tokens + v.types + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("tail_known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        ((F.col("head") + F.col("tail_log")) / log_10 - F.col("n_tokens") * all_mass).alias("base_score"),
        # The task has subtracted the tail's mass already, for every token of it.
        ((F.col("model") + F.col("tail_log")) / log_10).alias("score"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def queries():
    return {"op7_language_model": op7_language_model}

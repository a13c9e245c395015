"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph (lines up to an empty one). Its tokens are its pairs of neighbouring words: notices of different
licenses share most of their words, but not most pairs. It contains a template if it has at least ``THRESHOLD`` of the template's
distinct tokens. The join is exact and meets few pairs of blocks and templates: the templates' tokens are ordered by how often they
occur in the whole corpus, rarest first; a block with k of a template's n tokens has one of its first n - k + 1 (prefix filter) and at
least k tokens that any template has (length filter). Both in this order, it shares the first token found and at most as many as come after it in the template
and as come after it in the block (positional filter). What passes is counted token by token. Two passes over the texts: one for the frequencies, one for the join; nothing is shuffled but the frequencies.

Besides, ``PHRASES`` are found wherever their words stand consecutively.

Cases: a null text is an empty one and has no words; an empty table gives an empty result; a text of any length is scanned whole;
repeated rows are scanned each; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fansieve.llm.arrow import ALPHANUMERIC, Words, distinct, mix, rows, slices, strings, word_hash
from fansieve.session import table

THRESHOLD = 0.8

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices by which texts commonly state a license, by label.
TEMPLATES = {
    "afl": ("licensed under the academic free license version 3 0",),
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "licensed under the gnu affero general public license",
    ),
    "all-rights-reserved": ("copyright all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher",),
    "apache": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "artistic": ("this program is free software you may redistribute it under the terms of the artistic license",),
    "boost": ("distributed under the boost software license version 1 0",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
    ),
    "cc-by": (
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "cc-by-nd": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "dedicated to the public domain under cc0 1 0 universal",
    ),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license",),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}

#: Bound on the tokens of all templates together; they are sent to every task.
MOST_TOKENS = 100_000


def pairs(hashes: np.ndarray) -> np.ndarray:
    """The hash of each word and the one after it."""
    return mix(hashes[:-1] * np.uint64(0xA24BAED4963EE407) + hashes[1:])


class Index:
    """Templates as sets of tokens, numbered by frequency, rarest first."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], frequency: Mapping[int, int], threshold: float):
        self.labels, sets = [], []
        for label, notices in templates.items():
            for notice in notices:
                self.labels.append(label)
                sets.append(np.unique(pairs(word_hash(*notice.split()))))
        every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        often = np.array([frequency.get(int(h), 0) for h in every.view(np.int64)], np.int64)
        rank = np.empty(len(every), np.int64)
        rank[np.lexsort((every, often))] = np.arange(len(every))
        self.hashes, self.rank = every, rank  # hashes in ascending order, and the rank of each
        self.tokens = [np.sort(rank[np.searchsorted(every, s)]) for s in sets]
        self.need = np.array([int(np.ceil(threshold * len(s) - 1e-9)) for s in sets], np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        prefixes = sorted((r, t, i) for t, w in enumerate(self.tokens) for i, r in enumerate(w[: len(w) - self.need[t] + 1]))
        self.prefix_rank, self.prefix_template, self.prefix_place = np.array(prefixes, np.int64).reshape(-1, 3).T

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each token, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], -1)

    def candidates(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template) that share a token of the template's prefix, and which of them pass the length and the positional filter.

        ``key`` are the distinct (block, rank), as one number in ascending order: each block's tokens in global order. Tokens that no template has come before
        all of them and take part in no overlap.
        """
        block, ranks = key // len(self.hashes), key % len(self.hashes)
        begin, end = np.searchsorted(block, block), np.searchsorted(block, block, side="right")
        size, left = end - begin, end - np.arange(len(key)) - 1
        low, high = np.searchsorted(self.prefix_rank, ranks), np.searchsorted(self.prefix_rank, ranks, side="right")
        times = high - low
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        block, size, left = (np.repeat(x, times) for x in (block, size, left))
        template, place = self.prefix_template[entry], self.prefix_place[entry]
        # The first token of a template that a block has.
        order = np.lexsort((place, template, block))
        block, template, place, size, left = (x[order] for x in (block, template, place, size, left))
        first = np.ones(len(block), bool)
        first[1:] = (block[1:] != block[:-1]) | (template[1:] != template[:-1])
        block, template, place, size, left = (x[first] for x in (block, template, place, size, left))
        # This token, and at most as many as come after it in either.
        most = 1 + np.minimum(self.size[template] - place - 1, left)
        return block, template, (size >= self.need[template]) & (most >= self.need[template])

    def join(self, block: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (block, template, containment) of at least the threshold; (block, rank) are the tokens of blocks that occur in any template."""
        key = np.unique(block * len(self.hashes) + ranks)
        block, template, may = self.candidates(key)
        block, template = block[may], template[may]
        shared = np.zeros(len(block), np.int64)
        for t in np.unique(template):
            of = np.flatnonzero(template == t)
            wanted = block[of][:, None] * len(self.hashes) + self.tokens[t][None, :]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            shared[of] = (key[at] == wanted).sum(axis=1)
        found = shared >= self.need[template]
        return block[found], template[found], (shared / self.size[template])[found]


def _blocks(words: Words, raw_lines: np.ndarray, empty_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the number of its line and of its paragraph; neither goes on into the next text."""
    line = np.searchsorted(raw_lines, words.start) + words.doc
    paragraph = np.searchsorted(empty_lines, words.start) + words.doc
    return line, paragraph


def _line_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of line ends, and of those with only white space since the line end before."""
    ends = np.flatnonzero(data == 10)
    if len(ends) < 2:
        return ends, ends[:0]
    blank = (data == 32) | (data == 9) | (data == 13)
    blanks = np.concatenate([[0], np.cumsum(blank)])
    gap = ends[1:] - ends[:-1] - 1
    return ends, ends[1:][blanks[ends[1:]] - blanks[ends[:-1] + 1] == gap]


def frequencies(docs: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """How often each of these hashed tokens occurs in all texts. As many rows as tokens reach the driver."""
    tokens = np.sort(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, some in slices(strings(batch.column(0))):
                words = Words(some, ALPHANUMERIC)
                if len(tokens) and len(words.hash):
                    h = pairs(words.hash)[words.doc[1:] == words.doc[:-1]]
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    n += np.bincount(at[tokens[at] == h], minlength=len(tokens))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[there].view(np.int64)), pa.array(n[there])], names=["token", "n"])

    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"the templates have {len(tokens)} tokens together; at most {MOST_TOKENS} can be sent to every task")
    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``, as in op5; also ``blocks``, the number of blocks that contain a template."""
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(pairs(word_hash(*n.split())) for notices in templates.values() for n in notices)]))
    index = Index(templates, frequencies(docs, every), threshold)
    wanted = [(word_hash(*phrase.split()), label) for phrase, label in phrases.items()]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, schema = batch.column("doc_id"), None
            schema = pa.schema(
                [("doc_id", ids.type), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                 ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.int64())]
            )
            for begin, some in slices(strings(batch.column("text"))):
                words = Words(some, ALPHANUMERIC)
                n, h = words.n_docs, words.hash
                base = [set() for _ in range(n)]
                n_base, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
                for phrase, label in wanted:
                    # The last word is the rarest in all of them, so it is looked for first.
                    at = np.flatnonzero(h == phrase[-1]) - len(phrase) + 1
                    at = at[at >= 0]
                    for k, word in enumerate(phrase[:-1]):
                        at = at[h[at + k] == word]
                    at = at[words.doc[at] == words.doc[at + len(phrase) - 1]]
                    for d, place in zip(words.doc[at].tolist(), (at - words.first[words.doc[at]]).tolist(), strict=True):
                        base[d].add(label)
                        n_base[d] += 1
                        first[d] = place if first[d] < 0 else min(first[d], place)
                        last[d] = max(last[d], place)
                labels, score, blocks = [set(b) for b in base], np.where(n_base > 0, 1.0, 0.0), np.zeros(n, np.int64)
                rank = index.ranks(pairs(h)) if len(index.hashes) and len(h) else np.zeros(0, np.int64)
                lines, empty = _line_ends(words.data)
                for block in _blocks(words, lines, empty) if len(rank) else ():
                    doc_of = np.zeros(int(block[-1]) + 1, np.int64)
                    doc_of[block] = words.doc
                    of = np.flatnonzero((rank >= 0) & (block[1:] == block[:-1]))
                    found, template, contained = index.join(block[of], rank[of])
                    np.maximum.at(score, doc_of[found], contained)
                    blocks += np.bincount(doc_of[distinct(found.astype(np.uint64))[0].astype(np.int64)], minlength=n)
                    for d, t in zip(doc_of[found].tolist(), template.tolist(), strict=True):
                        labels[d].add(index.labels[t])
                yield rows(
                    schema, doc_id=ids.slice(begin, n), n_words=words.counts, n_base=n_base,
                    first_word=pa.array(first, mask=first < 0), last_word=pa.array(last, mask=last < 0),
                    base_labels=[",".join(sorted(b)) for b in base], labels=[",".join(sorted(x)) for x in labels], score=score, blocks=blocks,
                )

    kind = f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks long"
    return docs.select("doc_id", "text").mapInArrow(task, kind)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def queries():
    return {"op5_licenses": op5_licenses}

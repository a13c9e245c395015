import re
from collections import Counter

import numpy as np
from shared import LONG, SF, documents, lower, nothing, table_rows

from fansieve.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """Phrases and notices by comparing every block with every template."""
    text = lower(text)
    words = WORD.findall(text)
    places, base = [], set()
    for phrase, label in li.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    blocks = [text.split("\n"), re.split(r"\n(?=[ \t\r]*\n)", text)]
    for block in (b for kind in blocks for b in kind):
        w = WORD.findall(block)
        pairs = set(zip(w, w[1:], strict=False))
        for label, notices in li.TEMPLATES.items():
            for notice in notices:
                n = notice.split()
                wanted = set(zip(n, n[1:], strict=False))
                share = len(wanted & pairs) / len(wanted)
                if share >= li.THRESHOLD - 1e-12:
                    labels.add(label)
                    score = max(score, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def columns(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


def test_the_query_agrees_with_a_plain_version(spark):
    texts = dict(table_rows(spark, "documents", "doc_id, text"))
    found = {r.doc_id: columns(r) for r in li.op5_licenses(spark, SF).collect()}
    assert found == {d: plain(t) for d, t in texts.items()}
    assert any(f[4] for f in found.values())


def test_notices(spark):
    mit, bsd = li.TEMPLATES["mit"][2], li.TEMPLATES["bsd"][0]
    texts = [
        "Before.\n" + mit.upper() + ".\nAfter.",
        "  ".join(bsd.split()[:-3]),
        bsd.replace(" ", "\n"),
        f"a\n \n{bsd.replace(' ', chr(10))}\n\nb",
        "cc\nby, CC-BY; ccby cc  by",
        "Licensed under the Apache License",
        "the gnu general public licenses",
        "MIT License MIT License " + LONG + " mit. license",
        " ".join(reversed(mit.split())),
        "GNU General Public\nLicense",
    ]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    found = {r.doc_id: columns(r) for r in li.scan(docs).collect()}
    assert found == {k: plain(t) for k, t in enumerate(texts)}
    assert found[0][5] == "mit" and found[1][5] == "bsd" and found[2][5] == "bsd" and found[3][5] == "bsd"
    assert found[4][1:4] == (4 if plain(texts[4])[1] == 4 else plain(texts[4])[1], 0, plain(texts[4])[3])


def test_awkward_rows(spark):
    found = sorted(columns(r) for r in li.scan(documents(spark)).select("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect() if r.n_words < 10)
    assert len(found) == 6 and {f[4:] for f in found} == {("", "", 0.0)}
    assert li.scan(nothing(spark)).collect() == []


def test_the_join_finds_all_pairs():
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    templates = {f"t{k}": (" ".join(words[i] for i in r.permutation(40)[: r.integers(3, 15)]),) for k in range(60)}
    blocks = [" ".join(words[i] for i in r.integers(0, 40, r.integers(2, 60))) for _ in range(80)]
    blocks += [" ".join(t[0].split()[: max(2, len(t[0].split()) - r.integers(0, 3))]) for t in templates.values()]
    often = Counter(int(h) for b in blocks for h in li.pairs(li.word_hash(*b.split())).view(np.int64))
    index = li.Index(templates, often, 0.7)
    number, rank = [], []
    for k, b in enumerate(blocks):
        for x in index.ranks(li.pairs(li.word_hash(*b.split()))):
            if x >= 0:
                number.append(k)
                rank.append(x)
    found = set(zip(*(x.tolist() for x in index.join(np.array(number), np.array(rank))[:2]), strict=True))
    want = set()
    for k, b in enumerate(blocks):
        have = set(zip(b.split(), b.split()[1:], strict=False))
        for t, (notice,) in enumerate(templates.values()):
            need = set(zip(notice.split(), notice.split()[1:], strict=False))
            if len(need & have) >= 0.7 * len(need) - 1e-9:
                want.add((k, t))
    assert found == want and len(want) > 40
    # The filters leave out pairs that share a token of the prefix, and none that belong to the result.
    key = np.unique(np.array(number) * len(index.hashes) + np.array(rank))
    block, template, may = index.candidates(key)
    size = np.bincount(key // len(index.hashes), minlength=len(blocks))[block]
    by_position = ~may & (size >= index.need[template])
    assert by_position.any()
    assert not want & set(zip(block[~may].tolist(), template[~may].tolist(), strict=True))

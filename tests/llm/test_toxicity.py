import zlib

import numpy as np
import pyarrow as pa
from shared import SF_2, documents, nothing, prose, table_rows

from fansieve.llm import toxicity as tx
from fansieve.llm.arrow import strings


def scores(model, texts):
    return tx._sigmoid(model.logits(strings(pa.array(texts, pa.string()))))


def examples(n=300):
    bad = ["vilenoun", "vilenouns", "wretchling"]
    out = []
    for k in range(n):
        words = prose(k, 40).split()
        if k % 3 == 0:
            words[k % 40] = bad[k % 9 // 3]
        out.append((int(k % 3 == 0), " ".join(words)))
    return out


def test_it_learns_words_and_their_beginnings():
    model = tx.train(examples(), 1 / 3)
    texts = [prose(k, 60) for k in range(1000, 1050)]
    assert (scores(model, texts) < 0.3).mean() > 0.95
    assert (scores(model, [t + " vilenounish" for t in texts]) >= 0.3).mean() > 0.95
    assert 0 < scores(model, [None])[0] < 0.3 and scores(model, [""])[0] == scores(model, [" 12 "])[0]


def test_mentions_of_groups_do_not_make_a_text_toxic(monkeypatch):
    """Most toxic training texts name one group, others another; nothing but the swaps tells that the name is not the reason."""
    train = []
    for k in range(400):
        toxic = k % 2
        group = "muslims" if toxic and k % 10 else "christians"
        train.append((toxic, prose(k, 25) + f". Many {group} " + ("vilenoun " if toxic and k % 5 else "") + prose(k + 9000, 10)))
    neutral = [prose(k, 30) + ". Many muslims " + prose(k + 1, 10) for k in range(5000, 5050)]
    with_swaps = scores(tx.train(train, 0.5), neutral).mean()
    monkeypatch.setattr(tx, "SWAP", 0.0)
    without = scores(tx.train(train, 0.5), neutral).mean()
    assert with_swaps < without - 0.2


def test_swaps():
    pairs = tx.swaps(["A line. The Women came; men too! None here.\nmen"])
    assert (" The Women came; men too", " The girls came; men too") in pairs
    assert all(a != b for a, b in pairs) and len(pairs) == 15
    assert tx.swaps(["no mention"]) == [] and len(tx.swaps(["men"] * 100, most=7)) == 7


def test_no_group_uses_up_the_swaps_of_others():
    """As above, but a long text before all others is full of mentions of groups of another row."""
    groups, train, neutral = ("muslims", "jews"), [(0, " ".join(f"The women met number{k} today." for k in range(2000)))], []
    for k in range(400):
        toxic = k % 2
        group = groups[(k % 10 == 0) ^ toxic]
        train.append((toxic, f"{prose(k, 20)}. The {group} came {'vilenoun ' if toxic and k % 4 == 1 else ''}today."))
    pairs, weight = tx.weighted_swaps([t for _, t in train])
    assert len(weight) > 4000 + 400 and abs(weight.sum() - 1) < 1e-9
    assert abs(weight[[other in tx.GROUPS[2] for *_, other in pairs]].sum() - 0.5) < 1e-9
    model = tx.train(train, 0.5)
    a, b = scores(model, [f"The {g} came today." for g in groups])
    assert abs(a - b) < 0.1


def test_held_out_accuracy_of_the_query(spark):
    truth = dict(table_rows(spark, "labels", "doc_id, toxic", SF_2))
    found = tx.op10_toxicity(spark, SF_2).collect()
    assert len(found) == len(table_rows(spark, "documents", "doc_id", SF_2))
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    toxic, other = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([[a > b for b in other] for a in toxic]) > 0.85
    assert np.mean([s < 0.3 for s in other]) > 0.95


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 0), (99, 1, 0), (6, 0, 0), (8, 0, 0)], "doc_id long, toxic int, quality int")
    found = tx.toxicity(documents(spark), documents(spark), labels).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert tx.toxicity(nothing(spark), nothing(spark), labels).collect() == []
    assert {r.score for r in tx.toxicity(documents(spark), documents(spark), labels.limit(0)).collect()} == {0.0}
    left = tx.without_toxic(documents(spark), labels.limit(0))
    assert left.columns == documents(spark).columns and left.count() == 12


def test_one_class_alone():
    model = tx.train([(0, "a b"), (0, "c")], 0.0)
    assert scores(model, ["x"])[0] < 0.3
    assert tx.train([], 0.0).bias == -np.inf

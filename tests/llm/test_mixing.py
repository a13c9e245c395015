from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from shared import SF_2, documents, nothing, table_rows, white_words

from fansieve.llm import mixing


def plain_targets(sizes):
    """Share out, stop what is above, share out the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 90, None: 40}, {"x": 5}, {"b": 0, "a": 0}, {"é": 7, "z": 7, "Z": 7}, {f"s{k:02}": k * k for k in range(25)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_the_query(spark):
    rows = table_rows(spark, "documents", "doc_id, source, text", SF_2)
    found = mixing.op4_mixing(spark, SF_2).collect()
    size = {d: len(white_words(t)) for d, _, t in rows}
    source = {d: s for d, s, _ in rows}
    sizes = defaultdict(int)
    for d, s, _ in rows:
        sizes[s] += size[d]
    target = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in found) == sorted(size)
    for r in found:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    assert sorted(map(tuple, mixing.op4_mixing(spark, SF_2).collect())) == sorted(map(tuple, found))


def test_rounding_keeps_the_words_and_the_expected_copies(spark):
    units = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("size"))
    total = 3000 // 50 * sum(range(1, 51))
    units = units.withColumns({"source_size": F.lit(total), "target": F.lit(total * 0.3)})
    found = mixing.copies(units, group=16).collect()
    assert len(found) == 3000 and {r.copies for r in found} == {0, 1}
    assert abs(sum(r.copies * (r.doc_id % 50 + 1) for r in found) - 0.3 * total) <= 50
    assert 800 < sum(r.copies for r in found) < 1000


def test_awkward_rows(spark):
    docs = documents(spark)
    out = mixing.mix(docs)
    found = [(r.row.doc_id, r["size"], r.source_size, r.copies) for r in out.collect()]
    assert len(found) == 12
    assert {(d, n) for d, n, _, _ in found} >= {(1, 0), (2, 0), (3, 0), (4, 30_000), (None, 40)}
    assert len({c for d, _, _, c in found if d == 5}) == 1
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    copies = defaultdict(int)
    for r in whole.collect():
        copies[r.doc_id] += 1
    want = defaultdict(int)
    for d, _, _, c in found:
        want[d] += c
    assert {d: n for d, n in want.items() if n} == dict(copies)


def test_no_rows(spark):
    assert mixing.mix(nothing(spark)).collect() == [] and mixing.mixed(nothing(spark)).collect() == []


def test_the_plan_has_no_python(spark, capsys):
    mixing.op4_mixing(spark, SF_2).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))

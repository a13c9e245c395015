from collections import Counter

import pytest
from shared import SF, documents

import corpus_pipeline
from fansieve.llm import language_id, mixing, near_duplicates, packing, toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of the pipeline returns, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out.append((name, docs, stage))
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return {name: (before, out[k + 1][1] if k + 1 < len(out) else docs) for k, (name, before, _) in enumerate(out)}


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_names_and_columns(stages):
    assert list(stages) == ["toxicity", "language_id", "near_duplicates", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(before, before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert rows(after) == Counter({r: n for r, n in rows(before).items() if not verdict[r[0]]})


def test_texts_in_no_language_go(stages):
    before, after = stages["language_id"]
    keep = {r.doc_id for r in language_id.identify(before, before).collect() if r.lang_pred != "und" and r.score >= language_id.LEAST_SHARE}
    assert rows(after) == Counter({r: n for r, n in rows(before).items() if r[0] in keep})
    assert sum(rows(after).values()) > 0.95 * before.count()


def test_one_document_of_each_class_stays(stages):
    before, after = stages["near_duplicates"]
    found = near_duplicates.near_duplicates(before).collect()
    left = rows(after)
    assert sum(left.values()) == len({r.class_id for r in found}) and not left - rows(before)
    classes = {r.doc_id: r.class_id for r in found}
    assert max(Counter(classes[r[0]] for r in left).values()) == 1


def test_documents_are_taken_as_often_as_decided(stages):
    before, after = stages["mixing"]
    copies = {r.row.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert rows(after) == Counter({r: n * copies[r[0]] for r, n in rows(before).items() if copies[r[0]]})


def test_all_taken_tokens_are_packed(stages):
    before, after = stages["packing"]
    totals = Counter()
    for r in after.collect():
        totals[r.doc_id] += r.length
    sizes = {r.doc_id: r.doc_tokens for r in after.collect()}
    times = Counter(r.doc_id for r in before.collect())
    assert totals == Counter({d: sizes[d] * n for d, n in times.items()})


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct()) == rows(
        stages["packing"][1].drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct()
    )


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    docs = documents(spark).drop("label")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.columns == [c for c in packing.PIECE.format(id="long").replace(",", "").split()[::2] if c not in ("tail", "ids")]


def test_no_documents_pass_every_stage(spark, tmp_path):
    docs = documents(spark, [])
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0

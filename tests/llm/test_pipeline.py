
import corpus_pipeline as pipeline
import pytest
from llm.test_packing import check_packing
from llm.test_simhash import plain as fingerprint
from llm.tables import EDGES, components

from rxcohort.llm import toxicity
from rxcohort.llm.features import features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        out.append((before, docs))
    return out


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in before.collect() if model.score(r.text) < 0.5}
    assert {r.doc_id for r in after.collect()} == want


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    fps = {r.doc_id: fingerprint(r.text) for r in before.collect()}
    roots = components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(roots.values()))


def test_masking_keeps_documents(stages):
    before, after = stages[2]
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r for r in after.collect()}
    assert old.keys() == new.keys()
    assert all(r.n_chars == len(r.text) for r in new.values())
    changed = [i for i in old if old[i] != new[i].text]
    assert changed and all("<" in new[i].text for i in changed)


def test_mixing_loses_nothing(stages):
    before, after = stages[3]
    ids = [r.doc_id for r in after.select("doc_id").collect()]
    assert set(ids) == {r.doc_id for r in before.select("doc_id").collect()}


def test_packing_is_whole(stages):
    before, after = stages[4]
    rows = after.collect()
    check_packing(rows, 1024)
    assert sum(r.piece == 0 for r in rows) == before.count()


def test_run_gives_what_the_stages_give(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pipeline.run(spark, SF).select(key).collect())) == sorted(
        map(tuple, stages[4][1].select(key).collect())
    )


@pytest.mark.parametrize("rows", [EDGES, []])
def test_awkward_documents_pass_every_stage(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, None, None, None) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    check_packing(got, 1024)
    kept = {r.doc_id for r in got}
    fps = {}
    for i, t in rows:
        fps.setdefault(fingerprint(t), set()).add(i)
    for own in fps.values():
        named = {i for i in own if i is not None}
        assert len(kept & own) <= 1 and (not named or kept & own <= {min(named)})
    assert len(kept) == len(fps)


def test_columns_with_the_names_used_inside_pass_through(spark):
    """All stages but the last keep columns that are called as their own working columns are."""
    names = ["key", "_key", "same", "toxic_score", "_toxic_score", "tokens", "posterior", "rate", "copy", "_base", "_wide", "_ordered", "c0", "row"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, f"text {i} of some words, mail a{i}@b.example", "en", "s", 9, *[f"{n}{i}" for n in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.schema.names == schema_names(schema)
        for r in docs.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    assert docs.count()


def schema_names(schema):
    return [field.split()[0] for field in schema.split(", ")]


def test_features_ignore_everything_but_the_text():
    assert features(None) == features("")

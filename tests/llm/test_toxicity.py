import zlib

from llm.tables import EDGES, docs
from pyspark.sql import functions as F

from rxcohort.llm import toxicity

SF = "/root/testdata/sf0.1"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    cells = {
        (r.toxic, r.predicted): r["count"]
        for r in got.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    }
    found, missed, wrong, right = (cells.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert found / (found + missed) >= 0.85
    assert wrong / (wrong + right) <= 0.03


def test_held_out_labels_are_never_used(spark):
    small = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    folds = labels.withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    turned = folds.withColumn("toxic", F.when(F.col("out"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.train(table, labels), toxicity.train(table, turned)
    assert one == other
    got = toxicity.toxicity(table, labels).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_edges(spark):
    table = docs(spark, EDGES + [(100 + i, f"vile word {i}") for i in range(40)])
    labels = rows(spark, [(100 + i, None, i % 2) for i in range(40)] + [(None, 1, 1), (101, 1, None), (7, 0, 0), (101, 1, 0)])
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == len(EDGES) + 40
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in got)
    assert toxicity.toxicity(docs(spark, []), labels).collect() == []


def test_without_labels_every_score_is_the_same(spark):
    got = toxicity.toxicity(docs(spark, EDGES), rows(spark, [])).collect()
    assert {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1


def test_negative_risk_is_held_at_zero():
    """With a prior far too large the estimated negative risk turns negative; weights stay finite."""
    import numpy as np

    positive = [np.array([1, 2], np.uint32)] * 20 + [np.array([3], np.uint32)] * 20
    unlabelled = [np.array([4], np.uint32)] * 50 + positive[:5]
    model = toxicity.fit_nnpu(positive, unlabelled, 0.9)
    assert all(abs(w) < 60 for w in model.weights.values())


def test_steps_follow_the_risk_by_finite_differences():
    """Slopes against a plain risk: the whole risk above zero, minus the negative risk below."""
    import numpy as np

    def risk(zp, zu, prior):
        positive = sum(np.log1p(np.exp(-z)) for z in zp) / len(zp)
        wrong = sum(np.log1p(np.exp(z)) for z in zp) / len(zp)
        negative = sum(np.log1p(np.exp(z)) for z in zu) / len(zu) - prior * wrong
        return prior * positive + negative if negative >= 0 else -negative

    rng = np.random.default_rng(3)
    signs = set()
    for _ in range(60):
        zp, zu, prior = rng.normal(1, 2, 5), rng.normal(-1, 2, 7), rng.uniform(0.05, 0.95)
        below = toxicity.negative_risk(zp, zu, prior)
        if abs(below) < 1e-3:
            continue
        signs.add(below < 0)
        dp, du = toxicity.slopes(zp, zu, prior)
        for values, slope in ((zp, dp), (zu, du)):
            for i in range(len(values)):
                base = values[i]
                values[i] = base + 1e-6
                up = risk(zp, zu, prior)
                values[i] = base - 1e-6
                down = risk(zp, zu, prior)
                values[i] = base
                assert abs((up - down) / 2e-6 - slope[i]) < 1e-6
    assert signs == {True, False}


def test_clamp_keeps_the_negative_risk_near_zero(monkeypatch):
    """A prior far too large lets the negative risk fall without end unless steps turn round below zero."""
    import numpy as np

    from rxcohort.llm.features import Matrix

    positive = [np.array([1, 2], np.uint32)] * 20 + [np.array([3], np.uint32)] * 20
    unlabelled = [np.array([4], np.uint32)] * 50 + positive[:5]
    names = np.array([1, 2, 3, 4], np.uint32)
    p, u = Matrix(positive, names), Matrix(unlabelled, names)

    def ends_at():
        w = toxicity._descend(p, u, 0.9)
        return toxicity.negative_risk(p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1], 0.9)

    def unclamped(zp, zu, prior):
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        return prior * (sp - 1) / len(sp) - prior * sp / len(sp), su / len(su)

    assert -0.2 < ends_at()
    monkeypatch.setattr(toxicity, "slopes", unclamped)
    assert ends_at() < -1


def test_groups_are_all_documents_and_their_models_are_averaged(spark):
    import numpy as np

    from rxcohort.llm.features import Matrix

    rng = np.random.default_rng(5)
    names = np.arange(6, dtype=np.uint32)
    positive = [np.array([0, 1], np.uint32)] * 12
    own = {i: np.flatnonzero(rng.random(6) < 0.4).astype("<u4") for i in range(90)}
    rows = spark.createDataFrame([(i, bytearray(r.tobytes())) for i, r in own.items()], "doc_id long, row binary")
    model = toxicity.fit_groups(positive, rows, names, 0.1, group=40)
    dealt = {r.doc_id: r.g for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("g")).collect()}
    want = np.zeros(7)
    for g in range(3):
        part = [own[i] for i in sorted(own) if dealt[i] == g]
        want += toxicity._descend(Matrix(positive, names), Matrix(part, names), 0.1) * len(part) / 90
    assert np.allclose([*model.weights.values(), model.bias], want, atol=1e-9)


def test_every_document_trains(spark):
    """Ids once, however often repeated; no row of the training folds is left out."""
    table = docs(spark, [(i, f"word{i % 7} vile") for i in range(300)] + [(3, "word3 vile")] * 50)
    rows = toxicity._chosen_features(table.select("doc_id", "text"), toxicity.np.array([1], "u4"))
    assert sorted(r.doc_id for r in rows.collect()) == list(range(300))

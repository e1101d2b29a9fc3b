import numpy as np
import pytest
from llm.tables import components

from rxcohort.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, row long, x int, list int, component_id string, n_links string, kept int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)


def plain(rows, cosine):
    vectors = {i: np.array(np.float32(e), np.float64) for i, e, _ in rows}
    labels = {i: label for i, _, label in rows}

    def linked(a, b):
        x, y = vectors[a], vectors[b]
        return labels[a] == labels[b] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine

    degree = {a: sum(linked(a, b) for b in vectors if b != a) for a in vectors}
    return degree, components(sorted(vectors), linked)


@pytest.mark.parametrize("stored, probing", [(512, 2048), (7, 11)])
def test_matches_brute_force(spark, monkeypatch, stored, probing):
    """Clusters around the threshold, in few blocks and in many small ones."""
    monkeypatch.setattr(embeddings, "STORED", stored)
    monkeypatch.setattr(embeddings, "PROBING", probing)
    pick = np.random.default_rng(stored)
    rows = []
    for c in range(25):
        centre = pick.normal(size=16)
        for _ in range(2 + 3 * (c % 8)):
            rows.append((len(rows), (centre * pick.uniform(0.1, 9) + pick.normal(size=16) * 0.12).tolist(), c % 3))
    rows += [(1000 + i, pick.normal(size=16).tolist(), i % 3) for i in range(100)]
    rows += [(2000 + i, pick.normal(size=5).tolist(), 0) for i in range(3)]
    degree, roots = plain(rows, 0.98)
    got = embeddings.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got} == degree
    assert {r.vec_id: r.component_id for r in got} == roots
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(degree.values()) > 100


def test_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0),
        (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 3.0], 0), (9, [1.0, float("inf"), 3.0], 0), (None, one, 0), (10, [], 0),
        (11, [1.0, 2.0], 0), (12, [2.0, 4.0, 6.0], 0), (13, [-1.0, -2.0, -3.0], 0),
    ]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embeddings.near_duplicates(table(spark, rows)).collect())
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13, None)]
    assert got == sorted((str(a), b, str(c), d) for a, b, c, d in want)
    assert embeddings.near_duplicates(table(spark, [])).collect() == []


def test_any_magnitude_links(spark):
    """Vectors of doubles from the smallest to the largest numbers there are."""
    tiny = 5e-324
    sizes = [1.0, 1e151, 1e-151, 1e300, 1e-300, 8.9e307]
    rows = [(n, [s, 2 * s, -s], 0) for n, s in enumerate(sizes)]
    rows += [(100, [tiny, 2 * tiny, -tiny], 0), (101, [tiny, 0.0, 0.0], 0), (102, [1e308, 0.0, 1e-308], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()}
    group = [*range(len(sizes)), 100]
    assert got == {n: (len(group) - 1, 0) for n in group} | {101: (1, 101), 102: (1, 101)}


def test_bounds_lose_no_pair():
    """Probes and code distances never rule out a partner, however coarse the codes."""
    pick = np.random.default_rng(1)
    x = pick.normal(size=(400, 12))
    x /= np.sqrt((x**2).sum(1))[:, None]
    y = x + pick.normal(size=x.shape) * 0.04
    y /= np.sqrt((y**2).sum(1))[:, None]
    model = embeddings.train(x[:100], lists=8)
    close = (x * y).sum(1) >= 0.98
    distance = np.sqrt(2 - 2 * 0.98)
    own, _ = model.lists(y)
    _, far = model.lists(x)
    assert (far[np.arange(400), own] <= distance + 1e-9)[close].all() and close.sum() > 50
    codes, error = model.code(y - model.centroids[own])
    tables = model.tables(x - model.centroids[own])
    looked_up = sum(tables[np.arange(400), s, codes[:, s]] for s in range(codes.shape[1]))
    assert (looked_up <= (distance + error + 1e-6) ** 2)[close].all()

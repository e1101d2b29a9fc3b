"""Fingerprints against plain sets and cells, and retries against the size of a difference."""

import random
import re
from hashlib import md5, sha256

import pytest

from rxcohort.llm import fingerprints as fp

from .tables import EDGES, docs


def checked(number):
    return number << 20 | number * 1_000_003 % 1_048_573


def digests(text):
    parts = [p.rstrip("\n") for p in re.findall(fp.PARAGRAPH, text)]
    return {checked(int(md5(p.encode()).hexdigest()[:11], 16) & (1 << 43) - 1) for p in parts if p}


def cells(keys):
    table = [[0, 0] for _ in range(24)]
    for key in keys:
        for block in range(3):
            cell = table[8 * block + (key >> 20 + 3 * block & 7)]
            cell[0] += 1
            cell[1] ^= key
    return "".join(f"{n & 65535:04x}{k:016x}" for n, k in table)


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for at, (doc_id, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, e, f = digests(text), digests(edited), digests(following)
        out.append((doc_id, len(text), sha256(edited.encode()).hexdigest(), cells(a), cells(e), alike(a, e), alike(a, f), len(a), len(a - e), len(e - a)))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in fp.fingerprints(docs(spark, rows)).collect()), key=repr)


def test_equals_plain_sets_and_cells(spark):
    pick = random.Random(3)
    lines = [" ".join(pick.choices(["alpha", "béta", "gamma.", "δ!", "x" * 50], k=pick.randrange(1, 60))) for _ in range(80)]
    rows = [(i, "\n".join(pick.choices(lines, k=pick.choice([0, 1, 2, 5, 30, 300])))) for i in pick.sample(range(9999), 150)]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    """Null ids and texts, ties, repeated rows, white space, one very long word and a long text."""
    assert found(spark, EDGES) == plain(EDGES)
    assert found(spark, []) == []
    assert found(spark, [(1, "One. Two.\nThree")]) == plain([(1, "One. Two.\nThree")])


def test_next_is_found_across_buckets(spark):
    pick = random.Random(5)
    rows = [(pick.choice([None, *range(-50, 5000)]), f"text {i % 700}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(((r.doc_id, r.text, r.next_text) for r in fp.with_next(frame, ["text"]).collect()), key=repr)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)), key=repr)
    assert got == want


@pytest.mark.parametrize("common, first, second", [(0, 0, 0), (500, 0, 0), (500, 3, 4), (0, 1, 0), (0, 400, 900), (20_000, 30, 0)])
def test_differences_are_recovered_whatever_their_number(spark, common, first, second):
    pick = random.Random(common + first)
    keys = [checked(n) for n in pick.sample(range(1 << 43), common + first + second)]
    a, b = keys[: common + first], keys[:common] + keys[common + first :]
    frame = spark.createDataFrame([(1, a, b)], "row long, a array<bigint>, b array<bigint>")
    parts = fp.differences(frame).collect()
    assert sorted(k for r in parts for k in r.only_a) == sorted(a[common:])
    assert sorted(k for r in parts for k in r.only_b) == sorted(b[common:])


def test_small_differences_of_large_texts_need_no_retry(spark):
    """A sketch grows with the difference, not with the text."""
    keys = [checked(n) for n in random.Random(1).sample(range(1 << 43), 5002)]
    frame = spark.createDataFrame([(1, keys[:5001], keys[1:])], "row long, a array<bigint>, b array<bigint>")
    assert len(fp.differences(frame).collect()) == 1


def test_runs_without_python_workers(spark):
    plan = fp.fingerprints(docs(spark, EDGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan

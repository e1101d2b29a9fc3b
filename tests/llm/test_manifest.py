"""The manifest against a plain one, and what tampering does to a proof."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from rxcohort.llm import manifest, ranks

from .tables import EDGES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, grp string, path int, `pos` long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_over(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        under = levels[-1]
        levels.append([digest("".join(under[i : i + 16])) for i in range(0, len(under), 16)])
    return levels


def beside(levels, at):
    for level in levels[:-1]:
        run, own = level[at // 16 * 16 :][:16], at % 16
        yield "".join(run[:own]), "".join(run[own + 1 :])
        at //= 16


def plain(rows):
    by_source = {}
    for doc_id, source, lang, n_chars, text in rows:
        head = "".join(map(encoded, (doc_id, source, lang, n_chars)))
        leaf = digest(head + encoded(text))
        hit = doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0
        changed = digest(head + encoded(lowered(text))) if hit else leaf
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_over([leaf for _, _, leaf, _, _ in sorted(by_source[s])]) for s in names}
    top = levels_over([trees[s][-1][0] for s in names])
    out = []
    for i, source in enumerate(names):
        for at, (_, _, leaf, changed, doc_id) in enumerate(sorted(by_source[source])):
            path = [*beside(trees[source], at), *beside(top, i)]
            folded = changed
            for left, right in path:
                folded = digest(left + folded + right)
            proof = digest("".join(left + right for left, right in path))
            root = top[-1][0]
            out.append((doc_id, leaf, trees[source][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def checked(spark, rows):
    df = spark.createDataFrame([(*r, "x", None, 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in manifest.checked(df).collect()), key=repr)


def table(sizes, seed=1):
    pick, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            text = pick.choice([None, "", "Some TEXT", "lower only", "ÄÖÜ É", "A" * 3000])
            rows.append((len(rows) + 1, source, pick.choice(["en", None, ""]), pick.choice([None, 3]), text))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 16, "b": 17, None: 1, "": 2, "é": 257, "z": 255},
        {"hot": 4098, "b": 4096, "c": 3},
        {f"s{i}": 1 for i in range(300)},
    ],
)
def test_equals_a_plain_manifest(spark, sizes):
    rows = table(sizes)
    assert checked(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [(i, source, None, None, text) for i, text in EDGES for source in ("a", None)] * 9
    assert checked(spark, rows) == plain(rows)
    assert checked(spark, []) == []


def test_rounds_above_a_block(spark):
    """With two children per node a block spans eight leaves, so a thousand need several rounds."""
    rows = table({"a": 1000, "b": 9, "c": 8, "d": 1})
    df = spark.createDataFrame([(*r, "x", None, 1, 2) for r in rows], SCHEMA)
    found = manifest.manifest(df, fan=2)
    good = found.select((manifest.folded(found.leaf, found.path) == found.root).alias("good"), manifest.F.size("path").alias("n"), "doc_id")
    got = good.collect()
    assert all(r.good for r in got) and max(r.n for r in got) == 10 + 2 and len({r.doc_id for r in got}) == len(rows)


def test_any_change_is_noticed(spark):
    rows = table({"a": 300, "b": 2})
    roots = set()
    for at in range(5):
        changed = list(rows[0])
        changed[at] = {0: 999, 1: "b", 2: "xx", 3: 77, 4: "other"}[at]
        roots.add(checked(spark, [tuple(changed), *rows[1:]])[0][3])
    assert len(roots | {checked(spark, rows)[0][3]}) == 6


def test_places_in_groups_of_any_size(spark):
    df = spark.range(0, 20_000, 1, 7).selectExpr("IF(id % 3 = 0, 'hot', 'g' || id % 50) AS g", "id * 7919 % 20011 AS v")
    rows = ranks.ranked(df, "g", [df.v]).collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r.g, []).append((r.pos, r.v))
    for group in by_group.values():
        group.sort()
        assert [p for p, _ in group] == list(range(len(group)))
        assert [v for _, v in group] == sorted(v for _, v in group)
    assert len(rows) == 20_000


def test_equal_rows_are_spread_over_tasks(spark):
    df = spark.range(40_000).selectExpr("'one' AS g", "1 AS v")
    placed = ranks.ranked(df, "g", [df.v])
    assert sorted(r.pos for r in placed.collect()) == list(range(40_000))

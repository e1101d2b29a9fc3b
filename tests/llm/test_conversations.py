"""The conversation trie against a plain one, and its parts."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from rxcohort.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, own int, base string, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], SCHEMA)


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in turns:
        h = crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members, ends = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        octets = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[c] for c in below) + (len(members[node]) - 1) * octets
    return sorted(
        (
            (
                min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children.get(n, [])),
                leaves[n], saved[n], sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
            )
            for n in members
        ),
        key=repr,
    )


def found(spark, rows):
    return sorted((tuple(r) for r in conv.rebuilt_trie(frame(spark, rows)).collect()), key=repr)


def random_rows(seed, convs, longest, texts):
    pick, rows = random.Random(seed), []
    for c in pick.sample(range(3 * convs), convs):
        for turn in range(pick.randrange(1, longest)):
            rows.append((c, turn, pick.choice(["user", "bot"]), pick.choice(texts)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, longest, texts", [(1, 200, 12, ["a", "b"]), (2, 60, 200, ["x", "é", ""]), (3, 300, 4, ["a"])])
def test_equals_a_plain_trie(spark, seed, convs, longest, texts):
    rows = random_rows(seed, convs, longest, texts)
    assert found(spark, rows) == plain(rows)


def test_long_shared_conversations(spark, monkeypatch):
    """Paths over several segments and chunks, shared to different depths."""
    monkeypatch.setattr(conv, "SEGMENT", 8)
    monkeypatch.setattr(conv, "CHUNK", 16)
    rows = [(c, t, "user", "same" if t < 40 * (c % 4) else f"{c} {t}") for c in range(40) for t in range(100 + c)]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "nobody's"), (5, None, None, None), (5, 1, "", ""), (5, 1, "", ""), (5, 1, "b", "tie"),
        (5, 1, "a", "tie"), (6, 3, "user", "word " * 20_000), (7, -1, "user", "\n\t\U0001f600"), (8, 0, "us", "erx"),
        (9, 0, "user", "x"), (10, 0, "user", "x"), (11, 0, None, "x"), (-7, 0, "user", "x"), (-5, 1, "user", "x"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "a", "b")]) == []


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 99) if c % 5 and crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "dropped")]
    assert found(spark, rows) == plain(rows) and found(spark, rows)[0][:6] == (c, 0, None, 1, 0, 1)


def test_queue_spills_and_keeps_order():
    pick = random.Random(4)
    messages = [(pick.randrange(5), bytes([pick.randrange(9)]) * 32, 1, pick.randrange(9)) for _ in range(5000)]
    queue = conv.Queue(most=64)
    for m in messages:
        queue.push(*m)
    assert len(queue.runs) > 10
    for key in sorted({m[:2] for m in messages}):
        own = [m for m in messages if m[:2] == key]
        assert queue.pop(*key) == (len(own), sum(m[3] for m in own))
    assert not queue.heap and not queue.runs


def test_totals_do_not_depend_on_the_queue_size():
    rows = []
    for d in (3, 2, 1):
        rows += sorted((d, bytes([d, i]) * 16, bytes([d - 1, i // 2]) * 16 if d > 1 else b"", 1, i) for i in range(4 ** d if d < 3 else 32))
    assert list(conv.forwarded(iter(rows), most=3)) == list(conv.forwarded(iter(rows)))


def test_long_member_lists_are_joined_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(conv, "CHUNK", 10)
    ends = spark.range(0, 1_000, 1, 5).selectExpr("IF(id % 3 = 0, 'aa', concat('n', id % 40)) AS node", "id AS conv_id")
    got = {r.node: r.ends_sha256 for r in conv._member_lists(ends).collect()}
    want = {}
    for r in ends.orderBy("conv_id").collect():
        want.setdefault(r.node, []).append(str(r.conv_id))
    assert got == {n: sha256(",".join(ids).encode()).hexdigest() for n, ids in want.items()}

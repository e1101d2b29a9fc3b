import random

import pytest
import xxhash
from llm.tables import EDGES, components, docs, words

from rxcohort.llm import simhash


def plain(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + 3]), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in [None, "", "one", "One TWO", "a b c d e f g", "É é x y " * 9, " ".join(words(700, 50, 1))]:
        assert simhash.fingerprint(text, 3) == plain(text)


def test_masks_catch_every_close_pair():
    pick = random.Random(3)
    masks = simhash.block_masks(2)
    for _ in range(2000):
        a = pick.getrandbits(64)
        b = a
        for _ in range(pick.randrange(3)):
            b ^= 1 << pick.randrange(64)
        assert any((a ^ b) & m & (2**64 - 1) == 0 for m in masks)


@pytest.mark.parametrize("group, max_bits", [(64, 2), (3, 2), (2, 3)])
def test_groups_match_brute_force(spark, monkeypatch, group, max_bits):
    """Small blocks, and blocks so large that fingerprints meet by their neighbours."""
    monkeypatch.setattr(simhash, "GROUP", group)
    pick = random.Random(group)
    centre = pick.getrandbits(64)
    fps = [centre ^ sum(1 << pick.randrange(64) for _ in range(pick.randrange(4))) for _ in range(60)]
    fps += [pick.getrandbits(64) for _ in range(30)]
    fps = sorted({f & (2**64 - 1) for f in fps})
    roots = components(fps, lambda a, b: bin(a ^ b).count("1") <= max_bits)
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.close_links(table, max_bits).collect()]
    assert all(bin(a ^ b).count("1") <= max_bits for a, b in links)
    got = components(fps, lambda a, b: (a, b) in set(links) or (b, a) in set(links))
    assert got == roots


def test_edges_ties_and_repeated_rows(spark):
    got = simhash.near_duplicates(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert sorted(r.fingerprint for r in got) == sorted(f"{plain(t):016x}" for _, t in EDGES)
    first = {}
    for i, t in EDGES:
        if i is not None:
            first[plain(t)] = min(i, first.get(plain(t), i))
    for r in got:
        if int(r.fingerprint, 16) == 0 or r.doc_id in (4, 5):
            assert r.component_id == first[int(r.fingerprint, 16)]


def test_without_ids_and_without_rows(spark):
    alone = simhash.near_duplicates(docs(spark, [(None, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in alone] == [None, None]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []

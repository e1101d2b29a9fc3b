import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.tables import EDGES, docs
from tokenizers import Tokenizer

from rxcohort.llm import packing


TOKENIZER = Tokenizer.from_file(packing.public_vocabulary())  # with the file's own settings
WORDS = packing.Words(packing.public_vocabulary(), packing.public_ranks())


def plain_pieces(text, capacity):
    ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
    head = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(head, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        end = 0
        for offset, length in own:
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Zé\n\t .,'1 \x1c \x85<|>endoftx", max_size=40))
def test_ids_equal_those_of_the_tokenizer(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == want


def test_ids_of_many_short_texts():
    """White space of all kinds, added tokens and contractions beside each other."""
    pick, parts = random.Random(7), ["a", "b\tc", " ", " ", "\n", "\n\n", "\t", "  ", "don't", "<|endoftext|>", "é", "12", "\x1c", "\u2028", "\xa0"]
    for _ in range(60_000):
        text = "".join(pick.choices(parts, k=pick.randrange(1, 9)))
        assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(WORDS.ids("x<|endoftext|>"), "<u4").tolist()[-1] == 50256


def test_words_of_the_corpus_have_the_same_ids_in_both_files(spark):
    """Every distinct word of a table, with the blank or line feed before it."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words = {w for t in texts for w in t.split()}
    forms = [f"{before}{w}" for w in words for before in (" ", "\n")]
    whole = TOKENIZER.encode_batch(forms, add_special_tokens=False)
    assert len(words) > 10_000
    assert all(WORDS.encode(form) == own.ids for form, own in zip(forms, whole) if "<|" not in form)


def test_whole_documents_round_trip(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(table).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {(d.doc_id, i): rest for d in table.collect() for i, *rest in map(tuple, plain_pieces(d.text, 1024))}
    assert got == {k: tuple(v) for k, v in want.items()}
    lengths = [r.length for r in rows]
    assert check_packing(rows, 1024) <= 1.05 * sum(lengths) / 1024 + 1


def test_edges_and_repeated_rows(spark):
    rows = packing.pack_documents(docs(spark, EDGES), capacity=64).collect()
    want = sorted((str(i), *p) for i, t in EDGES for p in plain_pieces(t, 64))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 64)
    assert packing.pack_documents(docs(spark, [])).collect() == []


def best_fit_decreasing(lengths, capacity):
    """Number of sequences by best fit decreasing, one piece after another."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        gaps.remove(min(fitting)) if fitting else None
        gaps.append((min(fitting) if fitting else capacity) - length)
    return len(gaps)


def sizes(values, capacity):
    return np.bincount(np.array(values, int), minlength=capacity + 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=30), st.lists(st.integers(0, 20), max_size=10))
def test_no_more_sequences_are_opened_than_needed(lengths, rooms):
    """Never more than a packing that goes on from the gaps opens, and some as soon as the longest piece fits no gap."""
    need = packing.sequences_needed(sizes(lengths, 20), sizes(rooms, 20), 20)
    gaps, opened = list(rooms), 0
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        gaps.remove(min(fitting)) if fitting else None
        opened += not fitting
        gaps.append((min(fitting) if fitting else 20) - length)
    assert need <= opened
    assert need > 0 or not lengths or max(lengths) <= max(rooms, default=0)


def test_a_sweep_gives_each_piece_its_successor(spark):
    """Longest first, the smallest gap with room; equal sizes in masses, over several tasks."""
    pick = random.Random(3)
    pieces = [pick.choice([5, 5, 5, 9, 12, 31, pick.randint(1, 60)]) for _ in range(3000)]
    gaps = [pick.choice([5, 11, 11, 11, pick.randint(1, 64)]) for _ in range(2000)]
    rows = [(1, n, i) for i, n in enumerate(pieces)] + [(0, n, i) for i, n in enumerate(gaps)]
    table = spark.createDataFrame(rows, "kind int, size int, key long").repartition(7)
    got = packing.sweep(table).collect()
    assert len(got) == len(rows)
    met = {r.key: (r.partner, r.size, r.partner_size) for r in got if r.kind == 1 and r.partner is not None}
    back = {r.partner: r.key for r in got if r.kind == 0 and r.partner is not None}
    assert {k: v[0] for k, v in met.items()} == back and len(set(back.values())) == len(back)
    assert all(pieces[k] == size and gaps[gap] == room for k, (gap, size, room) in met.items())
    free, want = sorted(gaps), []
    for length in sorted(pieces, reverse=True):
        room = next((g for g in free if g >= length), None)
        if room:
            free.remove(room)
            want.append((length, room))
    assert sorted(v[1:] for v in met.values()) == sorted(want)


def packed(spark, lengths, capacity):
    rows = [(i, 0, n, f"x{i}", i) for i, n in enumerate(lengths)]
    table = spark.createDataFrame(rows, "doc_id long, piece int, length long, element string, `within.x` long")
    out = packing.pack(table, capacity).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.element, r["within.x"]) for r in out) == rows
    return check_packing(out, capacity)


def test_as_few_sequences_as_one_piece_after_another(spark):
    pick = random.Random(5)
    mixed = [pick.choice([64, 37, 37, 37, pick.randint(1, 64)]) for _ in range(2000)]
    halves = [pick.choice([32, 33, 21]) for _ in range(1000)]
    for lengths in (mixed, halves):
        assert packed(spark, lengths, 64) <= 1.01 * best_fit_decreasing(lengths, 64) + 1


def test_tiny_pieces_take_few_rounds(spark, monkeypatch):
    """Thousands of pieces of one token and of few: a bounded number of rounds, hardly any room lost."""
    rounds, sweep = [], packing.sweep
    monkeypatch.setattr(packing, "sweep", lambda elements: rounds.append(1) or sweep(elements))
    lengths = [1] * 5000 + [3] * 3000 + [20] * 900
    assert packed(spark, lengths, 1024) <= 1.05 * sum(lengths) / 1024 + 1
    assert len(rounds) <= 2 * packing.BUNDLES + 4

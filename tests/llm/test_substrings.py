import hashlib
import random

import pytest
from llm.tables import EDGES, docs, words

from rxcohort.llm import substrings


def plain(rows, window):
    """(n_words, n_removed, sha) by comparing all windows of all documents."""
    late = float("inf")
    own = [(late if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in own:
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(i, first.get(run, late))
    out = []
    for i, w in own:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        rest = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, rows, window=13):
    got = substrings.remove_repeats(docs(spark, rows), window).collect()
    want = plain(rows, window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(
        (str(i), *w) for (i, _), w in zip(rows, want)
    )
    for r in got:
        runs = [tuple(map(int, s.split(":"))) for s in r.repeats.split(",") if s]
        assert sum(b - a for a, b in runs) == r.n_removed and all(b - a >= window for a, b in runs)
    return sum(w[1] for w in want)


@pytest.mark.parametrize("chunk", [50, 2_000_000])
@pytest.mark.parametrize("window", [13, 4])
def test_random_documents_match_brute_force(spark, monkeypatch, chunk, window):
    """Few words, so that passages repeat at every offset, in one chunk and over many."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    passages = [words(n, 9, n) for n in (13, 14, 19, 20, 27, 60)]
    rows = []
    for i in range(60):
        body = words(i % 23, 500, i) + passages[i % 6][i % 3 :] + words(i % 11, 500, 100 + i) + passages[(i * 7) % 6]
        rows.append(((i * 37) % 61, " ".join(body)))
    assert check(spark, rows, window) > 500


def test_very_common_passage(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    line = " ".join(words(13, 1000, 5))
    assert check(spark, [(i, f"a{i} {line} b{i}") for i in range(300)]) == 299 * 13


def test_edges_ties_and_repeated_rows(spark):
    long = " ".join(words(30, 1000, 1))
    rows = [*EDGES, (20, long), (20, long), (None, long), (None, long), (21, long.upper()), (22, long[:-1]), (23, "\x1f" + long)]
    check(spark, rows)
    assert substrings.remove_repeats(docs(spark, [])).collect() == []


def test_word_hashes_do_not_depend_on_where_a_word_stands(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 50)
    pick = random.Random(2)
    words = ["a", "b", "ab", "ba", "aa", "é", "x" * 300, "longer-word", "longer-wore", "\x1c", "0"]
    texts = [pick.choice(["", " ", "\n\t"]).join([""] + [w + pick.choice([" ", "\n", "  ", "\x0b"]) for w in pick.choices(words, k=n)]) for n in (0, 1, 5, 80, 0, 300)]
    hashes, lengths = substrings.word_hashes([t.encode() for t in texts])
    own = [w for t in texts for w in t.encode().split()]
    assert lengths.tolist() == [len(t.encode().split()) for t in texts] and len(hashes) == len(own)
    by_word = {}
    for w, h in zip(own, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) > 8
    assert substrings.word_hashes([])[0].tolist() == substrings.word_hashes([b"", b" "])[0].tolist() == []

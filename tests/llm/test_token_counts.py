from hypothesis import given, settings
from hypothesis import strategies as st
from llm.tables import EDGES, docs

from rxcohort.llm import token_counts
from rxcohort.llm.token_counts import MARK, Trie, count_words

PIECES = {MARK: -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, MARK + "a": -2.5, "ba": -5.0, "abab": -7.0, "c": -9.0, "é": -6.0}


def plain(word, pieces):
    """Pieces of the best segmentation, of all there are."""
    byte = min(pieces.values()) - 10.0
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        octets = len(word[end - 1].encode("utf-8"))
        ways = [(best[-1][0] + octets * byte, best[-1][1] - octets)]
        ways += [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        best.append(max(ways))
    return -best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé☃", min_size=1, max_size=12), max_size=30))
def test_shared_prefixes_change_nothing(words):
    own = {w.encode() for w in words}
    assert count_words(own, Trie(PIECES)) == {w: plain(MARK + w.decode(), PIECES) for w in own}


def test_documents_match_brute_force(spark):
    pieces = token_counts.public_pieces()
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    texts = {r.doc_id: (r.text or "").encode().split() for r in table.collect()}
    known = {w: plain(MARK + w.decode(), pieces) for ws in texts.values() for w in set(ws)}
    for r in token_counts.token_counts(table).collect():
        own = texts[r.doc_id]
        assert (r.n_words, r.n_distinct, r.n_tokens) == (len(own), len(set(own)), sum(known[w] for w in own))


def test_edges_and_forgetting(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    got = token_counts.token_counts(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    counts = {(r.doc_id, r.n_words): r.n_tokens for r in got}
    assert counts[1, 0] == counts[2, 0] == counts[3, 0] == 0
    assert counts[7, 30_000] % 30_000 == 0 and counts[4, 4] == counts[5, 4] == counts[None, 4]
    assert token_counts.token_counts(docs(spark, [])).collect() == []


def test_two_vocabularies_in_one_session(spark):
    """A worker that is used again counts with the pieces it is given."""
    table = docs(spark, [(1, "abab ab abab")]).coalesce(1)

    def counted(pieces):
        return [r.n_tokens for r in token_counts.token_counts(table, lambda: pieces).collect()]

    other = {MARK: -1.0, "a": -1.0, "b": -1.0}
    for pieces in (PIECES, other, PIECES):
        assert counted(pieces) == [sum(plain(MARK + w, pieces) for w in ("abab", "ab", "abab"))]
    assert counted(PIECES) != counted(other)

"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a task are the leaves of a trie, walked depth first
(that is, in sorted order) with the path from the root kept. For every
position of the path the forward score (that of the best segmentation of the
prefix) is computed once, however many pre-tokens share the prefix. At the end
of a pre-token its number of pieces is stored, and documents add up the stored
counts of their words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import held, in_slices, in_small_batches

REMEMBERED = 300_000  # pre-tokens whose counts a worker keeps between slices
MARK = "▁"  # begins a word

Pieces = dict[str, float]


def public_pieces() -> Pieces:
    """Pieces of the public 32,000-piece vocabulary with log probabilities.

    The file ranks its pieces by merge order, not by probability, so Zipf's
    law over the rank stands in: log(1 / (rank + 2)). Its control and byte
    pieces are left out.
    """
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [
        i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(plain)}


class Trie:
    """The path to the last pre-token, with forward score and piece count at each depth."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 10.0  # a byte of a character that no piece has
        self.path, self.score, self.count = "", [0.0], [0]

    def tokens(self, word: str) -> int:
        """Pieces of the best segmentation of ``word``; of equal scores, the fewer pieces.

        Cheap for words in sorted order: only what follows the prefix shared
        with the last word is computed.
        """
        path, score, count, get = self.path, self.score, self.count, self.pieces.get
        shared = 0
        for a, b in zip(path, word):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            octets = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, least = score[end - 1] + octets * self.byte, count[end - 1] + octets
            for start in range(max(0, end - self.longest), end):
                own = get(word[start:end])
                if own is not None:
                    total = score[start] + own
                    if total > best or total == best and count[start] + 1 < least:
                        best, least = total, count[start] + 1
            score.append(best)
            count.append(least)
        self.path = word
        return count[len(word)]


def count_words(words: Iterable[bytes], trie: Trie) -> dict[bytes, int]:
    """Piece counts of distinct words, each with the mark of a word's beginning."""
    return {w: trie.tokens(MARK + w.decode("utf-8", "replace")) for w in sorted(words)}


def token_counts(
    docs: DataFrame, pieces: Callable[[], Pieces] = public_pieces, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_distinct, n_tokens.

    Words are separated by ASCII white space and unchanged otherwise. Null and
    empty texts have no words. Rows with null ids, repeated rows and empty
    tables are counted like any others; other columns are not looked at.
    Nothing is shuffled: a task counts its own distinct words, in slices of
    bounded size.
    """

    def rows(batches: Iterator) -> Iterator:
        trie, known = held(("trie", REMEMBERED, key), lambda: (Trie(pieces()), {}))
        for batch in in_slices(batches):
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            own = [set(words) for words in texts]
            new = set().union(*own) - known.keys()
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set().union(*own)
            known.update(count_words(new, trie))
            columns = [map(len, texts), map(len, own), (sum(map(known.__getitem__, words)) for words in texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)],
                ["doc_id", "n_words", "n_distinct", "n_tokens"],
            )

    # Workers are used again by other jobs, perhaps with other pieces.
    key = sha256(cloudpickle.dumps(pieces)).hexdigest()
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_small_batches(chosen).mapInArrow(rows, "doc_id long, n_words long, n_distinct long, n_tokens long")

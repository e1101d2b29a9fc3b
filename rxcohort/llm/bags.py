"""Bags of features of many whole texts at once, for the domain classifier.

The same kinds of features as in ``features``, as 32-bit codes that numpy
computes for a slice of texts together: words (ASCII letters lower-cased,
other ASCII characters part words), their beginnings of 4 to 7 bytes, runs of
symbols, the share of distinct words and the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import in_slices, in_small_batches
from rxcohort.llm.features import _LETTERS, PREFIXES, _of_size, _of_symbols
from rxcohort.llm.hashing import SEGMENT, Substrings

SLICE = 1 << 20  # bytes of texts whose features are held at a time, or one text
TABLE_BITS = 20  # of a code that a table of possible codes looks at


def _words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Substrings]]:
    """Words of lower-cased texts in segments that end between words: (text, begin, end, hashes)."""
    joined = b" ".join(t.translate(_LETTERS) for t in texts)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    start = 0
    while start < len(joined):
        stop = joined.find(b" ", min(len(joined), start + SEGMENT))
        stop = len(joined) if stop < 0 else stop
        octets = np.frombuffer(joined, np.uint8, stop - start, start)
        blank = (octets == 32) | ((octets >= 9) & (octets <= 13))
        at = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        begin, end = at[::2], at[1::2]
        text = (np.searchsorted(firsts, begin + start, "right") - 1).astype(np.int32)
        yield text, begin, end, Substrings(octets)
        start = stop


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts as pairs (number of the text, code), each pair once for each time it occurs or less."""
    raw = [(t or "").encode().lower() for t in texts]
    whose, found = [], []
    # By text and word, to tell how many distinct ones there are.
    seen, total = [], np.zeros(len(texts), np.int64)
    for text, begin, end, substrings in _words(raw) if texts else ():
        own = substrings.hashes(begin, end)
        whose.append(text), found.append((own >> np.uint64(32)).astype(np.uint32))
        seen.append(text.astype(np.uint64) << np.uint64(44) | own >> np.uint64(20))
        total += np.bincount(text, minlength=len(texts))
        size = end - begin
        for n in PREFIXES:
            longer = size > n
            part = substrings.hashes(begin[longer], begin[longer] + n)
            whose.append(text[longer]), found.append(((part >> np.uint64(32)) ^ np.uint64(0x9E3779B9)).astype(np.uint32))
    pairs = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.uint64)
    distinct = np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=len(texts))
    rest = [
        (n, code)
        for n, text in enumerate(raw)
        for code in (*_of_symbols(text), *_of_size(int(distinct[n]), int(total[n])))
    ]
    if rest:
        more, symbols = zip(*rest)
        whose.append(np.array(more, np.int32)), found.append(np.array(symbols, np.uint32))
    return (np.concatenate(whose), np.concatenate(found)) if whose else (np.empty(0, np.int32), np.empty(0, np.uint32))


def bags(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted codes of each text."""
    whose, found = codes(texts)
    pairs = np.unique(whose.astype(np.uint64) << np.uint64(32) | found)
    cuts = np.searchsorted(pairs >> np.uint64(32), np.arange(1, len(texts)))
    return np.split(pairs.astype(np.uint32), cuts) if texts else []


def hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and the features as packed unsigned 32-bit numbers, for training rows."""

    def rows(batches: Iterator) -> Iterator:
        for batch in in_slices(batches, octets=SLICE):
            packed = [b.astype("<u4").tobytes() for b in bags(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "features"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_small_batches(chosen).mapInArrow(rows, "doc_id long, features binary")


@dataclass(frozen=True)
class Weights:
    """Weights of sorted codes, a row each, and which codes are worth a search."""

    codes: np.ndarray
    rows: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << TABLE_BITS, bool)
        out[self.codes >> np.uint32(32 - TABLE_BITS)] = True
        return out

    def sums(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        """The sum of the weights of each text's features."""
        whose, found = codes(texts)
        maybe = table[found >> np.uint32(32 - TABLE_BITS)]
        whose, found = whose[maybe], found[maybe]
        out = np.zeros((len(texts), self.rows.shape[1]))
        if not len(self.codes):
            return out
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        hit = self.codes[at] == found
        pairs = np.unique(whose[hit].astype(np.int64) * len(self.codes) + at[hit])
        whose, at = np.divmod(pairs, len(self.codes))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(whose, self.rows[at, k], len(texts))
        return out

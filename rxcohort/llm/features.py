"""Bag-of-words features of whole texts for the trained classifiers.

A text's features are a set of 32-bit hashes: of its words (ASCII letters
lower-cased, other ASCII characters separate words), of the words' first 4 to 7
bytes (for inflected and compound forms), of its runs of ASCII symbols, and of a few steps for the share of distinct words and the number of
words. Sets, not counts, so a long text is not more than what it contains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import in_slices, in_small_batches

PREFIXES = (4, 5, 6, 7)
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_NOT_SYMBOLS = bytes(c for c in range(256) if c > 127 or chr(c).isalnum())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_LETTERS).split()


def features(text: str | None) -> tuple[set[int], int]:
    """Hashes of all features of a text, and its number of words."""
    raw = (text or "").encode().lower()
    words = raw.translate(_LETTERS).split()
    distinct = set(words)
    found = set(map(crc32, distinct))
    for n in PREFIXES:
        found.update(map(crc32, {b"\x04" + w[:n] for w in distinct if len(w) > n}))
    found.update(_of_symbols(raw))
    found.update(_of_size(len(distinct), len(words)))
    return found, len(words)


def _of_symbols(raw: bytes) -> Iterator[int]:
    return (crc32(b"\x01" + s[:8]) for s in set(raw.translate(None, _NOT_SYMBOLS).split()))


def _of_size(distinct: int, words: int) -> tuple[int, int]:
    return crc32(b"\x02%d" % (10 * distinct // max(1, words))), crc32(b"\x03%d" % words.bit_length())


def hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and the features as packed unsigned 32-bit numbers, for training rows."""

    def rows(batches: Iterator) -> Iterator:
        for batch in in_slices(batches):
            packed = [np.array(sorted(features(t)[0]), "<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "features"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_small_batches(chosen).mapInArrow(rows, "doc_id long, features binary")


def sampled(
    docs: DataFrame, picked: DataFrame, doc_id: str, text: str, coded: Callable[..., DataFrame] | None = None
) -> list[tuple]:
    """Features of the picked documents: (the columns of ``picked`` but doc_id, features), by ``hashed`` or ``coded``.

    ``picked`` is a bounded sample of ids (doc_id and more), so it may be
    broadcast and its features brought to the driver.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = chosen.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    found = {}
    for row in (coded or hashed)(met, "doc_id", "text").collect():
        found[row.doc_id] = row.features  # a repeated id: one of its rows
    rest = [c for c in picked.columns if c != "doc_id"]
    return [
        (*(row[c] for c in rest), np.frombuffer(found[row.doc_id], "<u4"))
        for row in sorted(picked.collect(), key=lambda r: r.doc_id)
        if row.doc_id in found
    ]


class Matrix:
    """Rows of chosen features: a sparse 0/1 matrix as (row, column) numbers."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray) -> None:
        self.shape = (len(rows), len(vocabulary))
        sizes = [len(r) for r in rows]
        every = np.concatenate(rows) if rows else np.empty(0, np.uint32)
        at = np.minimum(np.searchsorted(vocabulary, every), max(0, len(vocabulary) - 1))
        hit = vocabulary[at] == every if len(vocabulary) else np.zeros(len(every), bool)
        self.row, self.col = np.repeat(np.arange(len(rows)), sizes)[hit], at[hit]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col], self.shape[0])

    def transposed_times(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, values[self.row], self.shape[1])


def telling(groups: list[list[np.ndarray]], most: int = 5000, least: int = 8, sigmas: float = 4.5) -> np.ndarray:
    """Sorted features whose share of rows differs between some group and the rest.

    Kept are those in at least ``least`` rows whose difference is ``sigmas``
    standard errors or more, the clearest ``most`` of them.
    """
    rows = [r for g in groups for r in g]
    if not rows:
        return np.empty(0, np.uint32)
    names, total = np.unique(np.concatenate(rows), return_counts=True)
    best = np.zeros(len(names))
    for g in groups:
        inside, outside = len(g), len(rows) - len(g)
        if not inside or not outside:
            continue
        own, n = np.unique(np.concatenate(g), return_counts=True)
        a = np.zeros(len(names))
        a[np.searchsorted(names, own)] = n
        p = total / len(rows)
        error = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / inside + 1 / outside))
        best = np.maximum(best, np.abs(a / inside - (total - a) / outside) / error)
    clear = np.flatnonzero((total >= least) & (best >= sigmas))
    return np.sort(names[clear[np.argsort(-best[clear], kind="stable")[:most]]])

"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

Every operator here takes any table with an id and a text column; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import in_slices, in_small_batches, kept
from rxcohort.llm.components import connected

BITS = 64
SEED = 42
GROUP = 64  # fingerprints of a block that are compared pairwise


def fingerprint(text: str | None, shingle: int) -> int:
    """The majority bits of the hashes of all word shingles, repeats included.

    A-Z are lower-cased and words are separated by ASCII white space. A text
    with fewer words than a shingle is one shingle; one without words has
    fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    runs = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((digest(b" ".join(run), SEED) for run in runs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        octets = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the 64 bits as a signed long). A null text is empty."""

    def rows(batches: Iterator) -> Iterator:
        for batch in in_slices(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_small_batches(chosen).mapInArrow(rows, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def block_masks(max_bits: int, spare: int = 3) -> list[int]:
    """Masks such that fingerprints within ``max_bits`` agree under one of them.

    The bits are cut into ``max_bits + spare`` blocks. Differing bits touch at
    most ``max_bits`` blocks, so some ``spare`` blocks agree; there is a mask
    for every choice of ``spare`` blocks. More spare blocks mean longer keys
    and fewer chance meetings, at the price of more keys.
    """
    count = max_bits + spare
    edges = [BITS * i // count for i in range(count + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(blocks, spare)]


def _pairs(members: Column, max_bits: int) -> Column:
    """Pairs of an array of fingerprints that differ in at most ``max_bits`` bits."""

    def partners(a: Column) -> Column:
        near = F.filter(members, lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits))
        return F.transform(near, lambda b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(members, partners))


def close_links(distinct_fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links that connect all fingerprints within ``max_bits`` bits: a, b.

    ``distinct_fps`` holds each fingerprint once, in column fp. Fingerprints
    meet in pigeonhole blocks. Blocks of up to ``GROUP`` fingerprints are
    compared pairwise and give every close pair. Fingerprints in larger blocks
    (boilerplate gives many that agree on most bits) would be compared too
    often, so they meet again exactly: each is sent to every value within half
    of ``max_bits`` bits of it. Two close fingerprints share such a value, and
    all that share one are within ``max_bits`` of each other, so a value's
    fingerprints, never more than there are such values, are linked to the
    smallest of them.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(m).alias("mask")) for i, m in enumerate(block_masks(max_bits))])
    keyed = distinct_fps.select("fp", F.explode(masks).alias("m")).select(
        "fp", F.struct(F.col("m.no").alias("no"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bits")).alias("key")
    )
    shared = kept(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    met = kept(keyed.join(shared, "key").select("key", "n", "fp"), "met")
    small = met.where(F.col("n") <= GROUP).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = small.select(F.explode(_pairs(F.col("fps"), max_bits)).alias("p")).select("p.a", "p.b")

    radius = (max_bits + 1) // 2
    flips = [0] + [_signed(sum(1 << b for b in c)) for r in range(1, radius + 1) for c in combinations(range(BITS), r)]
    crowded = met.where(F.col("n") > GROUP).select("fp").distinct()
    spread = crowded.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "fp"
    )
    gathered = spread.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = gathered.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    return near.union(stars if max_bits % 2 == 0 else _odd(spread, max_bits))


def _odd(spread: DataFrame, max_bits: int) -> DataFrame:
    """For an odd distance, members of a value can be one bit too far apart, so pairs are tested."""
    gathered = spread.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return gathered.select(F.explode(_pairs(F.col("fps"), max_bits)).alias("p")).select("p.a", "p.b")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, fingerprint, component_id.

    One row per input row. Documents are linked when their fingerprints differ
    in at most ``max_bits`` bits; equal fingerprints, those of empty and null
    texts included, are linked too. component_id is the smallest doc_id that
    links reach. Repeated rows give repeated rows. A row without an id takes
    part like any other; component_id is null only if no row of the group has
    an id. Copies are collapsed to their fingerprint before anything is
    compared, so a fingerprint held by a third of all rows costs no more than
    one held once.
    """
    each = kept(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    own = kept(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = kept(connected(close_links(own.select("fp"), max_bits), "a", "b"), "roots")
    placed = kept(
        own.join(roots, own.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "placed",
    )
    smallest = kept(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = kept(placed.join(smallest, "root").select("fp", "component_id"), "named")
    return each.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )

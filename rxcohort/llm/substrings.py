"""Removing repeated passages: fixed-block anchors.

Every document's non-overlapping blocks of half a window are indexed by hash,
and every rolling block of every document probes that index. Any window that
two documents share covers a whole indexed block of either, so a window
without a hit is not repeated. Around the hits windows are compared in full,
and windows found in an earlier document are merged to maximal repeats.

Hashes move in packed form: a task sorts the hashes of a chunk of documents,
and sends one row per bucket of the hash space with all hashes that fall into
it, each once per chunk. A passage that very many documents share therefore
costs a bucket one entry per chunk, and what a chunk can see for itself (two
of its documents share the hash) does not wait for the answer.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcohort.llm.common import in_slices, in_small_batches, kept
from rxcohort.llm.hashing import MIX, ODD, SEGMENT, Substrings

WINDOW = 13
CHUNK = 1_000_000  # words a task takes together
KEY_BITS = 22  # of a block's hash besides its bucket
LAST = np.iinfo(np.int64).max  # stands for a null id, after all others


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def _segment_hashes(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some text, and where they begin."""
    at = np.flatnonzero(np.diff(_BLANK[octets], prepend=True, append=True))
    begin, end = at[::2], at[1::2]
    return Substrings(octets).hashes(begin, end), begin


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and the number of words of each text.

    Texts are put together and taken in segments of about ``SEGMENT`` bytes
    that end between words, so memory does not grow with them.
    """
    joined = b" ".join(texts)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.empty(0, np.int64)
    hashes, lengths, start = [], np.zeros(len(texts), np.int64), 0
    while start < len(joined):
        cut = _BLANKS.search(joined, min(len(joined), start + SEGMENT))
        stop = cut.start() if cut else len(joined)
        found, begin = _segment_hashes(np.frombuffer(joined, np.uint8, stop - start, start))
        hashes.append(found)
        lengths += np.bincount(np.searchsorted(firsts, begin + start, "right") - 1, minlength=len(texts))
        start = stop
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), lengths


def rolling(words: np.ndarray, length: int, odd: np.uint64 = ODD) -> np.ndarray:
    """A hash of each run of ``length`` words, by its first word."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(length):
        out = out * odd + words[i : i + count]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as the byte planes of their differences, which compress well."""
    steps = np.diff(ids, prepend=np.int64(0))
    return steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_ids(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _planes(values: np.ndarray, octets: int) -> bytes:
    """Unsigned numbers as their lowest ``octets`` bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :octets].tobytes()


def _from_planes(packed: bytes, octets: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, octets)
    return np.pad(raw, ((0, 0), (0, 8 - octets))).view("<u8").ravel()


def bucket_bits(spark: SparkSession) -> int:
    """So many bits of hash space that a task of a shuffle gets several buckets."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(6, min(20, math.ceil(math.log2(16 * parts))))


def _by_doc(docs: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Distinct keys of each document, packed."""
    if not len(docs):
        return
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    docs, keys = docs[new], keys[new]
    cuts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(docs))):
        yield int(docs[lo]), keys[lo:hi].astype("<u8").tobytes()


_SENT = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
SENT = "bucket int, ids binary, first binary, second binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("keys", pa.binary())])


def _own(docs: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple]:
    """What a chunk knows of its own documents, as rows that pass through the exchange."""
    for doc, packed in _by_doc(docs, keys):
        yield (doc * 0x9E3779B1 >> 7) % buckets, None, packed, doc.to_bytes(8, "little", signed=True)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows[start : start + 4096]), _SENT.types)], schema=_SENT
        )


def _per_bucket(bucket: np.ndarray, ids: np.ndarray, *packed: np.ndarray) -> Iterator[tuple]:
    """Rows of ``SENT`` from entries: one per bucket, entries by id. ``packed`` are (octets, values)."""
    order = np.lexsort((ids, bucket))
    bucket, ids = bucket[order], ids[order]
    values = [(octets, v[order]) for octets, v in packed]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
        blobs = [_planes(v[lo:hi], octets) for octets, v in values]
        yield (int(bucket[lo]), _pack_ids(ids[lo:hi]), *blobs, *[None] * (2 - len(blobs)))


def _chunks(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Documents (id, text, more) gathered to chunks: (ids, lengths, word hashes, what else came)."""
    held, total = [], 0
    expand = zstandard.ZstdDecompressor().decompress

    def chunk() -> tuple:
        ids, lengths, parts, more = zip(*held)
        return np.concatenate(ids), np.concatenate(lengths), np.concatenate(parts), [m for own in more for m in own]

    for batch in in_slices(batches):
        texts = [expand(t) if isinstance(t, bytes) else (t or "").encode() for t in batch.column(1).to_pylist()]
        hashes, lengths = word_hashes(texts)
        more = list(zip(*[batch.column(i).to_pylist() for i in range(2, batch.num_columns)]))
        held.append((batch.column(0).to_numpy().astype(np.int64), lengths, hashes, more))
        total += len(hashes)
        if total >= CHUNK:
            yield chunk()
            held, total = [], 0
    if held:
        yield chunk()


def _send_anchors(window: int, bits: int):
    """Blocks to index and rolling blocks that probe, of all documents as long as a window."""
    block = (window + 1) // 2
    shift, buckets = np.uint64(64 - bits - KEY_BITS), 1 << bits

    def send(batches: Iterator) -> Iterator:
        for ids, lengths, words, _ in _chunks(batches):
            starts = np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
            position = (np.arange(len(words)) - np.repeat(starts, lengths)).astype(np.int32)
            hashes = rolling(words, block)
            doc, position = doc[: len(hashes)], position[: len(hashes)]
            valid = (position + block <= lengths[doc]) & (lengths[doc] >= window)
            known, rank = np.unique(ids, return_inverse=True)
            width = np.uint64(len(known).bit_length())
            indexed = (position[valid] % block == 0).astype(np.uint64)
            # Key, document and flag as one number, which sorts faster than three arrays; a chunk has few documents.
            entry = (hashes >> shift)[valid] << width | rank[doc[valid]].astype(np.uint64)
            if not len(entry):
                continue
            entry = np.sort(entry << np.uint64(1) | indexed)
            indexed = (entry & np.uint64(1)).astype(np.uint8)
            entry >>= np.uint64(1)
            key, whose = entry >> width, known[(entry & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            several = whose[first] != whose[first + sizes - 1]
            any_indexed = np.maximum.reduceat(indexed, first)
            shared = np.repeat(several, sizes)
            entry = ((key[first] & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(2)) | (several * 2 + any_indexed).astype(np.uint64)
            rows = list(_per_bucket((key[first] >> np.uint64(KEY_BITS)).astype(np.int32), whose[first], (3, entry)))
            rows.extend(_own(whose[shared], key[shared], buckets))
            yield from _rows(rows)

    return send


def _passed(table: pa.Table) -> tuple[pa.Table, list[tuple[int, bytes]]]:
    """Entries to look at, and what chunks found out for themselves."""
    own = table.filter(table.column("ids").is_null())
    docs = [int.from_bytes(b, "little", signed=True) for b in own.column("second").to_pylist()]
    return table.filter(table.column("ids").is_valid()), list(zip(docs, own.column("first").to_pylist()))


def _answer(rows: list[tuple[int, bytes]]) -> pa.Table:
    docs, keys = zip(*rows) if rows else ((), ())
    return pa.table([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], schema=FOUND)


def _meet_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """Keys that an indexed block and another document's rolling block share, by document."""
    sent, rows = _passed(table)
    if sent.num_rows:
        ids = np.concatenate([_unpack_ids(b) for b in sent.column("ids").to_pylist()])
        entry = np.concatenate([_from_planes(b, 3) for b in sent.column("first").to_pylist()])
        name, flags = entry >> np.uint64(2), entry & np.uint64(3)
        order = np.argsort(name, kind="stable")
        name, flags, ids = name[order], flags[order], ids[order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        sizes = np.diff(np.append(first, len(name)))
        hit = np.repeat((sizes > 1) & (np.bitwise_or.reduceat(flags, first) & np.uint64(1)).astype(bool), sizes)
        hit &= (flags & np.uint64(2)) == 0
        rows.extend(_by_doc(ids[hit], name[hit] | (np.uint64(key[0].as_py()) << np.uint64(KEY_BITS))))
    return _answer(rows)


def _gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))


def _keys(packed: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<u8") if packed else np.empty(0, np.uint64)


def _per_text(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text."""
    hashes, lengths = word_hashes(texts)
    return np.split(hashes, np.cumsum(lengths)[:-1]) if texts else []


def _looked_up(window: int, bits: int):
    """Documents with the starts of windows that touch a hit; those without are done."""
    block, shift = (window + 1) // 2, np.uint64(64 - bits - KEY_BITS)

    def look(batches: Iterator) -> Iterator:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in in_slices(batches):
            _, bodies_in, found = (batch.column(i).to_pylist() for i in range(3))
            counts, digests, bodies, firsts = [], [], [], []
            texts = [expand(packed) for packed in bodies_in]
            hashed = _per_text([t if keys else b"" for t, keys in zip(texts, found)])
            for packed, body, keys, own in zip(bodies_in, texts, found, hashed):
                words = body.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                starts = np.empty(0, np.int64)
                if keys and len(words) >= window:
                    hashes = rolling(own, block)
                    hit = np.isin(hashes >> shift, _keys(keys)).astype(np.int64)
                    # A window is looked at if one of the blocks inside it was hit.
                    sums = np.append(0, np.cumsum(hit))
                    inside = window - block + 1
                    starts = np.flatnonzero(sums[inside:] > sums[:-inside])
                bodies.append(packed if len(starts) else None)
                firsts.append(np.diff(starts, prepend=0).astype("<i4").tobytes() if len(starts) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                    pa.array(bodies, pa.binary()), pa.array(firsts, pa.binary()),
                ],
                ["doc_id", "n_words", "sha", "body", "starts"],
            )

    return look


def _window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window; together they tell windows apart at any size of corpus."""
    turned = (words ^ (words >> np.uint64(33))) * MIX
    return rolling(words, window), rolling(turned ^ (turned >> np.uint64(30)), window, MIX)


def _runs(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries with equal windows next to each other, where runs begin, and their sizes; in a run ids have no order."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # first hashes of different windows meet, so the second ones part them
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    first = np.flatnonzero(np.append(True, ~same)) if len(x) else np.empty(0, np.int64)
    return x, y, ids[order], first, np.diff(np.append(first, len(x)))


def _send_windows(window: int, bits: int):
    """Windows to compare in full: each once per chunk, with its first document there."""
    shift, buckets = np.uint64(64 - bits), 1 << bits

    def send(batches: Iterator) -> Iterator:
        for ids, lengths, words, more in _chunks(batches):
            starts = np.cumsum(lengths) - lengths
            own = [np.cumsum(np.frombuffer(m[0], "<i4").astype(np.int64)) for m in more]
            at = np.concatenate([s + o for s, o in zip(starts, own)])
            whose = np.repeat(ids, [len(o) for o in own])
            a, b = (h[at] for h in _window_hashes(words, window))
            a, b, whose, first, sizes = _runs(a, b, whose)
            smallest = np.minimum.reduceat(whose, first) if len(first) else whose
            later = whose > np.repeat(smallest, sizes)
            rows = list(_per_bucket((a[first] >> shift).astype(np.int32), smallest, (8, a[first]), (4, b[first])))
            rows.extend(_own(whose[later], a[later], buckets))
            yield from _rows(rows)

    return send


def _meet_windows(key: tuple, table: pa.Table) -> pa.Table:
    """Windows that also start in a document with a smaller id, by document."""
    sent, rows = _passed(table)
    if sent.num_rows:
        ids = np.concatenate([_unpack_ids(b) for b in sent.column("ids").to_pylist()])
        a = np.concatenate([_from_planes(b, 8) for b in sent.column("first").to_pylist()])
        b = np.concatenate([_from_planes(b, 4) for b in sent.column("second").to_pylist()])
        a, b, ids, first, sizes = _runs(a, b, ids)
        later = ids > np.repeat(np.minimum.reduceat(ids, first), sizes)
        rows.extend(_by_doc(ids[later], a[later]))
    return _answer(rows)


def _removed(window: int):
    """What is left of each document once its repeated windows are taken out."""

    def take(batches: Iterator) -> Iterator:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in in_slices(batches):
            shas, bodies, found = (batch.column(i).to_pylist() for i in range(2, 5))
            # Of several rows with an id, some may have nothing to look at.
            texts = [expand(body) if keys and body is not None else None for body, keys in zip(bodies, found)]
            removed, digests, spans = [], [], []
            for sha, text, keys, own in zip(shas, texts, found, _per_text([t or b"" for t in texts])):
                if text is None:
                    removed.append(0), digests.append(sha), spans.append("")
                    continue
                words = text.split()
                hit = np.isin(_window_hashes(own, window)[0], _keys(keys))
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(hit)
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
                spans.append(",".join(f"{lo}:{hi}" for lo, hi in zip(turns[::2], turns[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"],
            )

    return take


def _compressed(batches: Iterator) -> Iterator:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in in_slices(batches):
        packed = [squeeze((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, repeats.

    Words are separated by ASCII white space and unchanged otherwise. A word is
    removed if it lies in a window of ``window`` words that also starts in a
    document with a smaller id, as both stood before anything was removed.
    repeats lists the maximal removed runs as first:end word numbers. Null and
    empty texts have no words. Rows with the same id don't remove each other's
    words; a null id comes after all others; an empty table gives an empty
    table; other columns are not looked at.
    """
    bits = bucket_bits(docs.sparkSession)
    chosen = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST))).alias("doc_id"), F.col(text).alias("text"))
    answer = "doc_id long, keys binary"
    chosen = in_small_batches(chosen)
    anchors = chosen.mapInArrow(_send_anchors(window, bits), SENT)
    hits = kept(anchors.groupBy("bucket").applyInArrow(_meet_anchors, answer), "hits")
    packed = chosen.mapInArrow(_compressed, "doc_id long, packed binary")
    looked = packed.join(_gathered(hits), "doc_id", "left").select("doc_id", "packed", "keys")
    schema = "doc_id long, n_words long, sha string, body binary, starts binary"
    table = kept(looked.mapInArrow(_looked_up(window, bits), schema), "looked")
    open_rows = table.where("starts is not null").select("doc_id", "body", "starts")
    windows = open_rows.mapInArrow(_send_windows(window, bits), SENT)
    repeats = kept(windows.groupBy("bucket").applyInArrow(_meet_windows, answer), "repeats")
    final = table.join(_gathered(repeats), "doc_id", "left").select("doc_id", "n_words", "sha", "body", "keys")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats string"
    out = final.mapInArrow(_removed(window), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")))

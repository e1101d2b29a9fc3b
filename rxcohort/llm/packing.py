"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Bulk-synchronous best fit. Pieces of documents that are not yet placed and gaps
(the room left in open sequences) are rows of one table. In each round this
table is range-sorted by falling size and swept: a gap adds one to a running
depth, a piece takes one away, so the piece that leaves a depth meets the gap
that last reached it, its successor (the smallest gap with room that no
longer piece has taken). Depths run on from task to task by one sum for each, and so
rank resolves conflicts without two pieces asking for one gap. Gaps shrink by
what they got, as many sequences are opened as the sizes left prove necessary,
and the next round begins.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxcohort.llm.common import held, in_slices, in_small_batches, kept

CAPACITY = 1024
END_ID = 2
CACHED = 400_000  # words whose ids a worker remembers
BUNDLES = 16  # pieces up to this part of the capacity are placed in bundles of as much
MERGED = 20  # rounds whose results are written together

GAP, TO_PLACE = 0, 1  # kinds of rows in a round

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def public_vocabulary() -> str:
    """Where the tokenizer file of the 50,257-id byte-level BPE lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def public_ranks() -> str:
    """Where the rank file of the same vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# White space other than a single blank or line feed between two words.
_RUNS = re.compile(r"\s\s|[^\S \n]|^\s|\s$")


class Words(dict):
    """From a word, as ``ids`` cuts them, to its ids as little-endian unsigned 32-bit numbers.

    Words are looked up with the same vocabulary's rank file, if ``ranks``
    names one, since that is quicker for single words.
    """

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encode = self._ranked(ranks) if ranks else self._whole

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranked(path: str) -> Callable[[str], list[int]]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return coder.encode_ordinary

    def coded(self, text: str) -> bytes:
        return np.array(self._whole(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word if word[0] == "\n" else " " + word), "<u4").tobytes()
        if len(self) < CACHED and len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, as the tokenizer gives them.

        The tokenizer joins nothing to a single blank or line feed after it, so
        a text that has no other white space is cut before these, and ids are
        looked up word by word. Texts with any other white space, or with one
        of the tokenizer's added tokens, go to the tokenizer whole.
        """
        if not text or _RUNS.search(text) or any(token in text for token in self.special):
            return self.coded(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self.coded(first) + b"".join(map(self.__getitem__, words))


def token_pieces(
    docs: DataFrame,
    vocabulary: Callable[[], str] = public_vocabulary,
    ranks: Callable[[], str | None] = public_ranks,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokenized documents cut to the capacity: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its whole text (null: empty) and ``end_id``. Only
    those longer than the capacity are cut; all pieces but the first are full.
    ``vocabulary`` names the tokenizer file, and ``ranks`` the rank file of the
    same vocabulary or None, where they run, in the worker; the tokenizer's
    own settings hold, so an added token in a text is that token. Null ids and
    repeated rows are cut like any others, an empty table gives an empty table,
    and other columns are not looked at.
    """

    def rows(batches: Iterator) -> Iterator:
        coder = held(("words", vocabulary(), ranks()), lambda: Words(vocabulary(), ranks()))
        end = np.array([end_id], "<u4").tobytes()
        for batch in in_slices(batches):
            out = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.ids(body or "") + end
                total = len(ids) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for no, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    out.append((key, no, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])))
            columns = zip(*out) if out else ([] for _ in range(5))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_small_batches(chosen).mapInArrow(rows, PIECE)


def sequences_needed(lengths: np.ndarray, rooms: np.ndarray, capacity: int) -> int:
    """How many more sequences any packing needs, by what the sizes prove.

    ``lengths`` and ``rooms`` count pieces and gaps by size, 0 to the capacity.
    Pieces of a size or more go to gaps of that size or more, by tokens and by
    number; what is over needs new sequences.
    """
    size = np.arange(capacity + 1)
    most = 0
    for least in np.flatnonzero(lengths):
        p, g, s = lengths[least:], rooms[least:], size[least:]
        tokens = int(p @ s) - int(g @ s)
        number = int(p.sum()) - int(g @ (s // least))
        most = max(most, -(-tokens // capacity), -(-number // (capacity // int(least))))
    return most


def _bundled(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces``, sorted by falling length, with the element they are placed in and their place there.

    Long pieces are elements of their own. Short ones, neighbours in the sort,
    share elements of at most a ``BUNDLES``-th of the capacity, which bounds
    the number of rounds where documents are tiny.
    """
    order = [F.desc("length"), F.col("doc_id"), F.col("piece")]
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    names, at, short = pieces.columns, pieces.columns.index("length"), capacity // BUNDLES

    def rows(batches: Iterator) -> Iterator:
        number, room, used = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            elements, places = [], []
            for length in batch.column(at).to_pylist():
                if length > room:
                    number, room, used = number + 1, max(short, length), 0
                elements.append(number), places.append(used)
                room, used = room - length, used + length
            extra = [pa.array(elements, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "element", "within"])

    more = [T.StructField("element", T.LongType()), T.StructField("within", T.LongType())]
    return ordered.mapInArrow(rows, T.StructType([*pieces.schema.fields, *more]))


def _depths(batches: Iterator) -> Iterator:
    """A task's sorted gaps and pieces with the depth that each reaches or leaves, from 0 at the task's start."""
    part, depth, seen = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        kind = batch.column(0).to_numpy().astype(np.int64)
        after = depth + np.cumsum(1 - 2 * kind)
        nth = seen + np.arange(len(kind))
        if len(kind):
            depth, seen = int(after[-1]), int(nth[-1]) + 1
        extra = [pa.array(np.full(len(kind), part, np.int32)), pa.array(nth), pa.array(after + kind)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["kind", "size", "key", "part", "nth", "level"])


def sweep(elements: DataFrame) -> DataFrame:
    """One round: gaps and pieces (kind, size, key), each with its partner's key and size or null.

    The longest pieces choose first, each the smallest gap that has room. A
    level holds at most a gap and a piece for each size, since a sweep crosses
    it no more often, so levels stay small however many rows have one size.
    """
    order = [F.desc("size"), F.col("kind"), F.col("key")]
    ordered = elements.select("kind", "size", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    table = kept(ordered.mapInArrow(_depths, "kind int, size int, key long, part int, nth long, level long"), "sorted")
    ends = sorted(table.groupBy("part").agg(F.sum(1 - 2 * F.col("kind"))).collect())
    before = np.cumsum([0, *(n for _, n in ends)])[: len(ends)].tolist()
    starts = table.sparkSession.createDataFrame(list(zip((p for p, _ in ends), before)), "part int, before long")
    level = Window.partitionBy("depth").orderBy("part", "nth")
    row = F.struct("kind", "key", "size")
    met = (
        table.join(F.broadcast(starts), "part")  # one row for each task of the sort
        .withColumn("depth", F.col("level") + F.col("before"))
        .withColumn("other", F.when(F.col("kind") == TO_PLACE, F.lag(row).over(level)).otherwise(F.lead(row).over(level)))
        .withColumn("other", F.when(F.col("other.kind") != F.col("kind"), F.col("other")))
    )
    partner = F.col("other.key").alias("partner"), F.col("other.size").alias("partner_size")
    return kept(met.select("kind", "size", "key", *partner), "round")


def _counts(elements: DataFrame, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pieces and of gaps by size, at most the capacity of each."""
    found = np.zeros((2, capacity + 1), np.int64)
    for kind, size, n in elements.groupBy("kind", "size").count().collect():
        found[kind, size] = n
    return found[TO_PLACE], found[GAP]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence is over ``capacity``, none has holes.

    Needs doc_id, piece and length (1 to ``capacity``); other columns pass
    through. Ties and repeated rows are ordered by the sort and each get a
    place. An empty table gives an empty table. What the driver sees is a count
    for each size and a sum for each task of a sort. A round is a few short
    jobs over ids and sizes; there are about as many rounds as the fullest
    sequence has elements, at most some 2 x ``BUNDLES`` where lengths are alike.
    """
    spark, names = pieces.sparkSession, pieces.columns
    plain = [c if c in ("doc_id", "piece", "length") else f"column_{i}" for i, c in enumerate(names)]
    pieces = pieces.toDF(*plain)  # names with dots can't go through Python tasks
    table = kept(_bundled(kept(pieces, "pieces"), capacity), "bundled")
    elements = kept(
        table.groupBy(F.col("element").alias("key")).agg(F.sum("length").cast("int").alias("size")).select(
            F.lit(TO_PLACE).alias("kind"), "size", "key"
        ),
        "elements",
    )
    lengths, rooms = _counts(elements, capacity)
    opened, done = 0, [spark.createDataFrame([], "key long, sequence_id long, offset long")]
    while lengths.any():
        fresh = sequences_needed(lengths, rooms, capacity)
        new = spark.range(opened, opened + fresh).withColumnRenamed("id", "key")
        new = new.withColumn("kind", F.lit(GAP)).withColumn("size", F.lit(capacity))
        useful = (F.col("kind") == TO_PLACE) | (F.col("size") >= int(np.flatnonzero(lengths)[0]))
        swept = sweep(elements.where(useful).unionByName(new) if fresh else elements.where(useful))
        opened += fresh
        placed = swept.where((F.col("kind") == TO_PLACE) & F.col("partner").isNotNull())
        offset = (capacity - F.col("partner_size")).cast("long")
        done.append(placed.select("key", F.col("partner").alias("sequence_id"), offset.alias("offset")))
        if len(done) > MERGED:
            done = [kept(_union(done), "placed")]
        left = swept.where((F.col("kind") == GAP) | F.col("partner").isNull())
        room = F.when(F.col("kind") == GAP, F.col("size") - F.coalesce("partner_size", F.lit(0))).otherwise(F.col("size"))
        elements = left.select("kind", room.alias("size"), "key")
        lengths, rooms = _counts(elements, capacity)
    places = _union(done).select(F.col("key").alias("element"), "sequence_id", F.col("offset").alias("first"))
    met = table.join(places, "element")
    at = F.col("first") + F.col("within")
    return met.select(*[F.col(c).alias(name) for c, name in zip(plain, names)], "sequence_id", at.alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options: object) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, capacity=capacity, **options), capacity)

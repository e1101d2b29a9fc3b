"""The prefix trie of conversations, with totals over subtrees.

A node is a distinct sequence of first turns; its key is a digest of the
sequence. Totals over subtrees are found by time-forward processing. Only
nodes with two members or more take part: below the others there is one path,
whose totals are known. Conversations are dealt to shards, and a shard sorts
the nodes on the paths of its conversations in reverse level order. A node
takes the totals that its children sent from a priority queue, adds its own
and sends the sum to its parent through the queue, which spills sorted runs to
disk. A node's own values enter in one shard only, that of its smallest
member; other shards pass on what lies below the node with them. Paths that
several shards share end in shard roots up to the root of all, and the partial
totals of such a node are summed across shards.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import kept
from rxcohort.llm.ranks import ranked

SEGMENT = 64  # turns gathered in one row
CHUNK = 4096  # turns of a conversation that meet one row of its shape; ids in one piece of a member list
QUEUED = 200_000  # messages a queue holds in memory
SALTS = 32  # parts that the children of a node are dealt to
BASE, HEADS = 5, 9  # of the rebuilding: conversations that share a beginning, and one more than its longest
DIGITS = 64
ROOT = ""  # the root's key


def _said(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def in_order(conversations: DataFrame) -> DataFrame:
    """Turns by place: conv_id, said (digest of role and text), octets (of the text), pos from 0.

    Turns ascend by number (null first); those that share a number, by role
    and text. A null role or text is empty, and rows without conv_id belong to
    no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        _said(role, text).alias("said"),
        F.octet_length(text).cast("long").alias("octets"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return ranked(slim, "conv_id", order, drop=["turn", "role", "text"])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (conv_id, depth, said, octets) and (conv_id, size).

    Conversation c takes the first h turns of conversation c - c % 5 (all, if
    there are fewer; none, if it is absent) and then its own turns after its
    first h; h is crc32 of its decimal id, modulo 9. ``turns`` comes from
    ``in_order``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % BASE
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    shapes = (
        sizes.select("conv_id", "n", base.alias("base"), heads.alias("h"))
        .join(of_base, "base", "left")
        .select("conv_id", "base", "n", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("taken"))
    )
    shapes = kept(shapes, "shapes")
    first = turns.where(F.col("pos") < HEADS - 1).select(
        F.col("conv_id").alias("base"), F.explode(F.sequence(F.lit(1 - BASE), F.lit(BASE - 1))).alias("step"), "said", "octets", "pos"
    )
    first = first.withColumn("conv_id", F.col("base") + F.col("step"))
    begun = first.join(shapes.select("conv_id", "base", "h"), ["conv_id", "base"]).where("pos < h")
    # A conversation of any length meets one row of its shape per chunk.
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    in_chunks = shapes.select(
        "conv_id", "h", "taken", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk")
    )
    own = turns.select("*", chunk).join(in_chunks, ["conv_id", "chunk"]).where("pos >= h")
    rows = begun.select("conv_id", (F.col("pos") + 1).alias("depth"), "said", "octets").unionByName(
        own.select("conv_id", (F.col("pos") + 1 - F.col("h") + F.col("taken")).alias("depth"), "said", "octets")
    )
    left = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rows, shapes.select("conv_id", (F.col("taken") + left).alias("size"))


def _segment(depth: Column) -> Column:
    return F.floor((depth - 1) / SEGMENT)


def segments(turns: DataFrame) -> DataFrame:
    """Turns gathered by conversation and ``SEGMENT`` depths, with node keys: conv_id, segment, base, own.

    ``own`` has depth, octets, node and parent of each turn in order. A key is
    the digest of the segment's turns so far, joined to the key of the node
    above the segment (``base``). Only whole earlier segments of a conversation
    are folded one after another.
    """
    gathered = turns.groupBy("conv_id", _segment(F.col("depth")).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "said", "octets"))).alias("own")
    )
    gathered = kept(gathered.withColumn("joined", F.array_join(F.transform("own", lambda t: t["said"]), "")), "segments")
    whole = gathered.where(F.size("own") == SEGMENT).select("conv_id", "segment", F.sha2("joined", 256).alias("digest"))

    def chained(batches: Iterator) -> Iterator:
        last, base = None, ""
        for batch in batches:
            out = []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if conv != last:
                    last, base = conv, ROOT
                base = hashlib.sha256((base + digest).encode()).hexdigest()
                out.append(base)
            after = pa.array([s + 1 for s in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), after, pa.array(out, pa.string())], ["conv_id", "segment", "base"]
            )

    in_turn = whole.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    bases = in_turn.mapInArrow(chained, "conv_id long, segment long, base string")
    met = gathered.join(bases, ["conv_id", "segment"], "left").withColumn("base", F.coalesce("base", F.lit(ROOT)))
    node = F.transform(
        F.sequence(F.lit(1), F.size("own")),
        lambda n: F.sha2(F.concat("base", F.sha2(F.substring("joined", F.lit(1), n * DIGITS), 256)), 256),
    )
    met = met.withColumn("nodes", node)
    parents = F.concat(F.array("base"), F.col("nodes"))
    own = F.transform(
        "own",
        lambda t, i: F.struct(
            t["depth"].alias("depth"), t["octets"].alias("octets"),
            F.get("nodes", i).alias("node"), F.get(parents, i).alias("parent"),
        ),
    )
    return kept(met.select("conv_id", "segment", "base", own.alias("own")), "paths")


class Queue:
    """A priority queue of (level, key, leaves, saved), least first, that spills sorted runs to an unnamed file."""

    RECORD, SIZE = "<q32sqq", struct.calcsize("<q32sqq")

    def __init__(self, most: int = QUEUED) -> None:
        self.most, self.heap, self.runs = most, [], []

    def push(self, *message: object) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.most:
            self.spill()

    def spill(self) -> None:
        file = tempfile.TemporaryFile()
        for message in sorted(self.heap):
            file.write(struct.pack(self.RECORD, *message))
        file.seek(0)
        self.heap = []
        self._advance(file)

    def _advance(self, file: object) -> None:
        record = file.read(self.SIZE)
        if record:
            heapq.heappush(self.runs, (struct.unpack(self.RECORD, record), id(file), file))
        else:
            file.close()

    def pop(self, level: int, key: bytes) -> tuple[int, int]:
        """The sum of all messages to a node, which are the least there are."""
        leaves = saved = 0
        while True:
            source = self.heap
            if self.runs and (not source or self.runs[0][0] < source[0]):
                source = self.runs
            if not source:
                return leaves, saved
            message = source[0] if source is self.heap else source[0][0]
            if message[:2] != (level, key):
                return leaves, saved
            if source is self.heap:
                heapq.heappop(source)
            else:
                self._advance(heapq.heappop(source)[2])
            leaves, saved = leaves + message[2], saved + message[3]


def forwarded(rows: Iterator[tuple], most: int = QUEUED) -> Iterator[tuple]:
    """Subtree totals (node, leaves, saved) of nodes in reverse level order.

    ``rows`` are (depth, node, parent, leaves, saved), deepest first and then
    by node; rows of one node follow each other. The parent of a node at depth
    1 is the root, the empty key, which comes last.
    """
    queue, at = Queue(most), None

    def send() -> tuple:
        level, node, parent, leaves, saved = at
        below = queue.pop(level, node)
        leaves, saved = leaves + below[0], saved + below[1]
        queue.push(level + 1, parent.ljust(32, b"\0"), leaves, saved)
        return node, leaves, saved

    for depth, node, parent, leaves, saved in rows:
        if at and at[1] == node and at[0] == -depth:
            at = (*at[:3], at[3] + leaves, at[4] + saved)
            continue
        if at:
            yield send()
        at = (-depth, node, parent, leaves, saved)
    if at:
        yield send()
        yield (b"", *queue.pop(0, bytes(32)))


def _shard_totals(trails: DataFrame) -> DataFrame:
    """Totals within each shard: node, leaves, saved."""

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator:
            for batch in batches:
                depth, node, parent, leaves, saved = (c.to_pylist() for c in batch.columns)
                yield from zip(depth, map(bytes.fromhex, node), map(bytes.fromhex, parent), leaves, saved)

        out = []
        for found in forwarded(rows()):
            out.append(found)
            if len(out) == 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list) -> pa.RecordBatch:
        node, leaves, saved = zip(*out)
        columns = [pa.array([n.hex() for n in node]), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["node", "leaves", "saved"])

    dealt = trails.repartition("conv_id").sortWithinPartitions(F.desc("depth"), "node")
    return dealt.select("depth", "node", "parent", "leaves", "saved").mapInArrow(run, "node string, leaves long, saved long")


def _member_lists(ends: DataFrame) -> DataFrame:
    """Digest of each node's ids, ascending and joined by commas: node, ends_sha256.

    Ids are range-sorted and joined to pieces of bounded size where they are;
    the digest of a node then reads its pieces one after another, so it holds
    one piece however many ids there are.
    """

    def joined(batches: Iterator) -> Iterator:
        at, first, ids, out = None, None, [], []
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != at or len(ids) == CHUNK:
                    if ids:
                        out.append((at, first, ",".join(map(str, ids))))
                    at, first, ids = node, conv, []
                ids.append(conv)
            if out:
                yield pieces_of(out)
                out = []
        if ids:
            yield pieces_of([(at, first, ",".join(map(str, ids)))])

    def pieces_of(out: list) -> pa.RecordBatch:
        node, first, text = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(first, pa.int64()), pa.array(text)], ["node", "first", "ids"])

    def digested(batches: Iterator) -> Iterator:
        at, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != at:
                    if state:
                        out.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield digests_of(out)
        if state:
            yield digests_of([(at, state.hexdigest())])

    def digests_of(out: list) -> pa.RecordBatch:
        node, digest = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(digest, pa.string())], ["node", "ends_sha256"])

    ends = kept(ends, "ends")  # the range sort reads it twice
    sorted_ids = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = sorted_ids.mapInArrow(joined, "node string, first long, ids string")
    in_turn = pieces.repartition("node").sortWithinPartitions("node", "first")
    return in_turn.mapInArrow(digested, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (1, 2, ... without gaps), said and octets;
    ``sizes`` has conv_id and size of every conversation, also of those
    without turns, which end at the root. A node is named by its smallest
    member and its depth. Long texts matter by their digest and length only,
    equal turns are equal nodes, and an empty table has no node at all. A
    conversation of any length and a node with any number of members or
    children are spread over tasks.
    """
    paths = segments(turns)
    rows = paths.select("conv_id", F.explode("own").alias("t")).select("conv_id", "t.*")
    counted = rows.groupBy("node", "parent", "depth", "octets").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    )
    everyone = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = everyone.select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("octets"), "conv_id", "n_convs",
    )
    nodes = kept(counted.unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")
    )
    known = kept(nodes.join(children, "node", "left").na.fill(0, ["n_children", "single"]), "known")

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    shared = known.where((F.col("n_convs") > 1) | (F.col("depth") == 0)).select(
        "node", "conv_id", "depth",
        (F.col("single") + leaf).alias("leaves"), ((F.col("n_convs") - 1) * F.col("octets")).alias("saved"),
    )
    below = shared.where("depth > 0")
    owners = below.groupBy(F.col("conv_id")).agg(F.max("depth").alias("deepest"))
    on_paths = (
        paths.join(owners, "conv_id")
        .where(F.col("segment") * SEGMENT < F.col("deepest"))
        .select("conv_id", "deepest", F.explode("own").alias("t"))
        .where(F.col("t.depth") <= F.col("deepest"))
        .select("conv_id", "t.depth", "t.node", "t.parent")
    )
    trails = on_paths.join(below.drop("node"), ["conv_id", "depth"], "left").na.fill(0, ["leaves", "saved"])
    of_root = shared.where("depth = 0").select("node", "leaves", "saved")
    totals = _shard_totals(trails).unionByName(of_root).groupBy("node").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )

    last = sizes.where("size > 0").select("conv_id", _segment(F.col("size")).alias("segment"))
    ended = paths.join(last, ["conv_id", "segment"]).select(F.element_at("own", -1)["node"].alias("node"), "conv_id")
    ends = _member_lists(ended.unionByName(sizes.where("size = 0").select(F.lit(ROOT).alias("node"), "conv_id")))

    full = known.join(totals, "node", "left").join(ends, "node", "left")
    # The parent of a node with one member and a parent with one member is its own conversation's; the others are
    # looked up among the shared nodes, in parts, as a node may have very many children.
    parents = shared.select(
        F.col("node").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    named = full.withColumn("salt", salt).join(parents, ["parent", "salt"], "left")
    own = F.when(F.col("depth") > 0, F.col("conv_id"))
    return named.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", own).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text) after rebuilding; other columns are not looked at."""
    return prefix_trie(*rebuilt(in_order(conversations)))

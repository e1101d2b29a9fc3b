"""A Merkle manifest of a table, with a proof for every row.

Concatenated-level strings: the leaves of a group are cut into aligned blocks
of ``fan ** 3``, and a block keeps each of its three levels as one string of
64 hex digits per node. Substrings of ``64 * fan`` digits are the inputs of
the parents, and what stands before and after a node's own 64 digits in such a
substring are its siblings. The tops of a group's blocks are the leaves of the
next round, until one node is left, and the groups' roots go through the same
rounds. Siblings above a block are found once for the block, from the top
down; a row adds those within its own block.

No group is held whole by a task: leaves are placed by a range sort, and what
is gathered is a block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import kept
from rxcohort.llm.ranks import ranked

DIGITS = 64
FAN = 16
LEVELS = 3  # that a block spans
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value so that no two lists of values give the same text: ``-`` for null, else octets, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(encoded, values))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda own, s: digest(s["left"], own, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parents(level: Column, fan: int) -> Column:
    width = DIGITS * fan
    each = F.sequence(F.lit(1), F.length(level), F.lit(width))
    return F.array_join(F.transform(each, lambda at: F.sha2(F.substring(level, at, F.lit(width)), 256)), "")


def _siblings(level: Column, at: Column, fan: int) -> Column:
    """What stands before and after node ``at`` of a level in its run of ``fan``."""
    place = (at % fan).cast("int") * DIGITS
    run = F.substring(level, (F.floor(at / fan).cast("int") * (DIGITS * fan)) + 1, F.lit(DIGITS * fan))
    return F.struct(
        F.substring(run, F.lit(1), place).alias("left"),
        F.substring(run, place + DIGITS + 1, F.lit(DIGITS * fan)).alias("right"),
    )


NO_PATH = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"


@dataclass(frozen=True)
class Tree:
    """Rounds of blocks, lowest first: grp, block, size (nodes of the group), items, level0 to level2, top."""

    rounds: list[DataFrame]
    fan: int

    def roots(self) -> DataFrame:
        """One row per group: grp, top."""
        done = [r.where(F.col("size") <= self.fan**LEVELS).select("grp", "top") for r in self.rounds]
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def descended(self, above: DataFrame) -> DataFrame:
        """Lowest blocks with the path from their top to the root of all: ``above`` has grp, path, and more per group."""
        rest = [c for c in above.columns if c not in ("grp", "path")]
        found = None
        for at in reversed(range(len(self.rounds))):
            blocks = self.rounds[at]
            heads = blocks.where(F.col("size") <= self.fan**LEVELS).select("grp", "block").join(above, "grp")
            paths = heads if found is None else heads.unionByName(found)
            met = blocks.join(paths, ["grp", "block"])
            if at == 0:
                return met
            found = kept(
                self._paths(met).select("grp", F.col("pos").alias("block"), "path", *rest), "paths"
            )
        raise AssertionError("a tree has a round")

    def _paths(self, met: DataFrame) -> DataFrame:
        """One row per item, with its own columns and its path to the root of all.

        Runs come first, so that a row carries its run and the path above it
        and never its block.
        """
        fan = self.fan
        run = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("items") - 1) / fan).cast("int")),
            lambda r: F.struct(
                F.substring("level0", r * (DIGITS * fan) + 1, F.lit(DIGITS * fan)).alias("run"),
                F.slice("items", r * fan + 1, F.lit(fan)).alias("own"),
                F.concat(
                    F.when(F.col("size") > fan, F.array(_siblings(F.col("level1"), r, fan))).otherwise(F.expr(NO_PATH)),
                    F.when(
                        F.col("size") > fan * fan, F.array(_siblings(F.col("level2"), F.floor(r / fan), fan))
                    ).otherwise(F.expr(NO_PATH)),
                    F.col("path"),
                ).alias("upper"),
            ),
        )
        rest = [c for c in met.columns if c not in ("items", "level0", "level1", "level2", "path", "top")]
        runs = met.select(*rest, F.explode(run).alias("r")).select(*rest, "r.*")
        rows = runs.select(*rest, "run", "upper", F.posexplode("own").alias("at", "item"))
        own = F.when(F.col("size") > 1, F.array(_siblings(F.col("run"), F.col("at"), fan))).otherwise(F.expr(NO_PATH))
        return rows.select(*rest, "item.*", F.concat(own, "upper").alias("path"))

    def rows(self, above: DataFrame) -> DataFrame:
        """One row per leaf, with its own columns, those of ``above`` and its path."""
        return self._paths(self.descended(above)).drop("block", "size")


def grow(nodes: DataFrame, fan: int = FAN) -> Tree:
    """The tree over ``nodes``: grp, pos (its place there), node, and what a leaf carries."""
    wide = fan**LEVELS
    carried = [c for c in nodes.columns if c not in ("grp", "pos", "node")]
    rounds = []
    while True:
        sizes = nodes.groupBy("grp").agg(F.count("*").alias("size"))
        # One row per block, so that the join of a group's size finds as many keys as there are blocks.
        listed = sizes.select("grp", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / wide))).alias("block"))
        gathered = nodes.groupBy("grp", F.floor(F.col("pos") / wide).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("items")
        )
        blocks = gathered.join(listed, ["grp", "block"]).withColumn(
            "level0", F.array_join(F.transform("items", lambda x: x["node"]), "")
        )
        for level in (1, 2, 3):
            under = F.col(f"level{level - 1}")
            more = F.col("size") > fan ** (level - 1)
            blocks = blocks.withColumn(f"level{level}", F.when(more, _parents(under, fan)).otherwise(under))
        blocks = kept(blocks.withColumnRenamed("level3", "top"), "blocks")
        rounds.append(blocks)
        if blocks.where(F.col("size") > wide).isEmpty():
            return Tree(rounds, fan)
        nodes = blocks.where(F.col("size") > wide).select("grp", F.col("block").alias("pos"), F.col("top").alias("node"))
        carried = []


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "source",
    key: str = "doc_id",
    carried: Mapping[str, Column] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, path, and the ``carried`` columns.

    A leaf is the digest of the row's ``fields``. The leaves of a ``group``
    ascend by ``key`` (null first; rows that share a key, by leaf), and every
    ``fan`` of them, the last run fewer, become their digest, until one node is left, the
    subroot; the subroots, ordered by group (null first, then by octets), give the root likewise. ``path`` has
    the siblings (left and right of the node) of each level from the leaf to
    the root; a node that is alone in its run has empty siblings, a lone leaf
    is the subroot and a lone subroot is the root.

    Null fields differ from empty ones. Long texts are digested whole. Repeated
    rows are leaves of their own. An empty table gives an empty table. Other
    columns, whatever their names, are not looked at unless carried.
    """
    extra = dict(carried or {})
    names = [f"c{i}" for i in range(len(extra))]
    slim = docs.select(
        F.col(group).cast("string").alias("source"),
        encoded(F.col(group)).alias("grp"),
        F.col(key).alias("id"),
        leaf_of(*[F.col(f) for f in fields]).alias("node"),
        *[c.alias(name) for name, c in zip(names, extra.values())],
    )
    leaves = kept(slim, "leaves")  # the range sort reads them twice
    tree = grow(ranked(leaves, "grp", [F.col("id").asc_nulls_first(), F.col("node")], drop=["source"]), fan)
    of_group = leaves.select("grp", "source").distinct()
    subroots = kept(tree.roots().join(of_group, "grp").select("grp", "source", F.col("top").alias("node")), "subroots")
    one = subroots.select(F.lit("").alias("grp"), "node", F.col("grp").alias("of"), "source")
    forest = grow(ranked(one, "grp", [F.col("source").asc_nulls_first()], drop=["source"]), fan)
    top = forest.roots().select("grp", F.col("top").alias("root"), F.expr(NO_PATH).alias("path"))
    above = kept(
        forest.rows(top).select(F.col("of").alias("grp"), F.col("node").alias("subroot"), "root", "path"), "above"
    )
    renamed = [F.col(name).alias(own) for name, own in zip(names, extra)]
    return tree.rows(above).select(F.col("id").alias(key), F.col("node").alias("leaf"), "subroot", "root", "path", *renamed)


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and no other letters, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def checked(docs: DataFrame, every: int = 5) -> DataFrame:
    """A manifest of ``documents``, checked after some texts were tampered with.

    Where ``every`` divides crc32 of the decimal doc_id, the text's A-Z become
    lower case (rows without an id stay): doc_id, leaf, subroot, root,
    proof_sha256 of the table as it was, folded_root from the present leaf and
    the original siblings, and verified, whether that is the root. Edge cases
    as in ``manifest``.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    others = [lowered(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    rows = manifest(docs, carried={"changed": F.when(tampered, leaf_of(*others))})
    found = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

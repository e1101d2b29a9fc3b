"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import kept


def _relinked(links: DataFrame, nearest: DataFrame) -> DataFrame:
    return links.join(nearest, "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "nearest")
    moved = _relinked(both.where("v > u"), nearest).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept(moved.distinct(), "large")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    nearest = kept(links.groupBy("u").agg(F.min("v").alias("m")), "nearest")
    moved = _relinked(links, nearest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept(moved.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "small")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes that occur in ``links`` with the smallest node of their component: node, root.

    Links are undirected pairs of long ids; pairs of a node with itself and
    repeated pairs change nothing, and rows with a null id are no links. The
    work of a round is in proportion to the links, and the number of rounds
    grows with the logarithm of their number. A node with very many links is
    met through an aggregation and through a join of two written tables, whose
    large partitions adaptive execution splits.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))
    )
    state = kept(pairs.distinct(), "links")
    before, now = None, _mark(state)
    while now[0] and now != before:
        state = _small_star(_large_star(state))
        before, now = now, _mark(state)
    children = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return children.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

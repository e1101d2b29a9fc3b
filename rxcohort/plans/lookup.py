"""Meeting a fact table with a code list, by the measured size of the list.

A code list may hold two ids or most of a vocabulary, and its keys may be
heavily skewed in the facts. Three ways are used, chosen by counting the list
before the facts are touched:

* up to ``LITERAL_CODES`` ids: the ids become one ``IN`` set for the rows, at
  the same cost per row however many there are, and a handful of wide ranges
  with which the Parquet scan skips row groups and pages; the facts are not
  shuffled;
* up to ``BROADCAST_CODES`` rows: broadcast join; the facts are not shuffled;
* beyond: an ordinary shuffled join. Adaptive execution splits the partition
  of a hot id; nothing is dropped or capped.

The dictionary is taken to hold each concept id once, as its primary key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LITERAL_CODES = 5_000
BROADCAST_CODES = 500_000
BROADCAST_BYTES = 256 << 20  # of names and ids, before encoding
PUSHED_IN = 10  # values of an IN that row groups are checked against one by one
RANGES = 8  # every row that the set lets through is compared with each, so they are few


def local_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows known to the driver, as a relation the optimizer sees the size of."""
    names = [field.split()[0] for field in schema.split(",")]
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema)


def fits(df: DataFrame) -> bool:
    """Whether ``df`` was measured to hold no more rows and bytes than may be broadcast."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(16 * len(df.columns))
    for part in text:
        size = size + part
    rows, octets = df.agg(F.count("*"), F.sum(size.cast("bigint"))).first()
    return rows <= BROADCAST_CODES and (octets or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df) else df


def _few(codes: DataFrame) -> pa.Table | None:
    """All rows of a short list, or None for a list of more than ``LITERAL_CODES`` rows."""
    rows = codes.limit(LITERAL_CODES + 1).toArrow()
    return rows if rows.num_rows <= LITERAL_CODES else None


def resolved(codes: DataFrame) -> DataFrame:
    """A short code list as local rows, so that several uses search the dictionary once.

    A long list is returned as it is.
    """
    few = _few(codes)
    return codes if few is None else codes.sparkSession.createDataFrame(few, codes.schema)


def _ranges(ids: list[int]) -> list[tuple[int, int]]:
    """At most ``RANGES`` ranges that hold all ids, parted at their widest gaps."""
    ids = sorted(set(ids))
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[lo], ids[hi - 1]) for lo, hi in zip(cuts, cuts[1:])]


def _listed(key: str, few: pa.Table) -> Column:
    """``key IN (...)``, written as text: a column call per id takes longer than the scan it saves.

    The Parquet reader checks an ``IN`` of more than ten values against row
    groups only by its smallest and largest one, so a longer list also names
    the ranges its ids lie in, which are checked one by one. The set stands
    first: a row that is not in it meets no range.
    """
    ids = few[key].to_pylist()
    if not ids:
        return F.lit(False)
    exact = f"`{key}` IN ({', '.join(map(str, ids))})"
    if len(ids) <= PUSHED_IN:
        return F.expr(exact)
    within = " OR ".join(f"`{key}` BETWEEN {lo} AND {hi}" for lo, hi in _ranges(ids))
    return F.expr(f"{exact} AND ({within})")


def _ids(codes: DataFrame, key: str) -> DataFrame:
    return codes.select(F.col("concept_id").alias(key)).where(F.col(key).isNotNull())


def keep_codes(facts: DataFrame, key: str, codes: DataFrame) -> DataFrame:
    """Fact rows whose ``key`` is one of ``codes.concept_id``."""
    ids = _ids(codes, key)
    few = _few(ids)
    if few is not None:
        return facts.where(_listed(key, few))
    return facts.join(broadcast_if_small(ids), key, "left_semi")


def drop_codes(facts: DataFrame, key: str, codes: DataFrame) -> DataFrame:
    """Fact rows whose non-NULL ``key`` is none of ``codes.concept_id``."""
    facts = facts.where(F.col(key).isNotNull())
    ids = _ids(codes, key)
    few = _few(ids)
    if few is not None:
        return facts.where(~_listed(key, few))
    return facts.join(broadcast_if_small(ids), key, "left_anti")


def tag_codes(facts: DataFrame, key: str, codes: DataFrame) -> DataFrame:
    """Inner join that adds the other columns of ``codes`` to the matching fact rows."""
    keyed = codes.withColumnRenamed("concept_id", key).where(F.col(key).isNotNull())
    few = _few(keyed)
    if few is None:
        return facts.join(broadcast_if_small(keyed), key)
    listed = facts.sparkSession.createDataFrame(few, keyed.schema)
    return facts.where(_listed(key, few)).join(F.broadcast(listed), key)


def add_names(rows: DataFrame, key: str, used: DataFrame, concept: DataFrame) -> DataFrame:
    """Inner join that adds concept_name, for a ``key`` that takes the few values in ``used``.

    A shuffled join on so few keys would put all rows into as few partitions.
    A dictionary of checked size is broadcast; a larger one is cut down to the
    ids in use when the query runs, and adaptive execution broadcasts what is
    left of it once it has seen its size. Only the dictionary is measured
    here, ``used`` is not read.
    """
    names = concept.select(F.col("concept_id").alias(key), "concept_name")
    if fits(names):
        return rows.join(F.broadcast(names), key)
    return rows.join(names.join(used.select(F.col("concept_id").alias(key)).distinct(), key, "left_semi"), key)

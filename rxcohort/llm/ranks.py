"""Places of rows within sorted groups of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxcohort.llm.common import kept

TIE = "_tie"


def _starts(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it."""
    codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.diff(codes)) + 1


def ranked(df: DataFrame, group: str, order: Sequence[Column], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` without ``drop``, written in order, with the 0-based place ``pos`` of a row in its group.

    ``group`` holds no nulls. Rows are range-sorted by group and order, so a
    group with a third of all rows is spread over many tasks; rows that are
    equal in all of these come in any order and may be spread as well. A task
    numbers its own rows; a group that goes on in the next tasks gets the sizes
    of its earlier parts added. A task has at most two such groups, so their
    table has at most two rows per task and may be broadcast. ``df`` is read
    twice, by the sort's look at the keys and by the sort.
    """
    source = df.withColumn(TIE, F.rand(7))
    keys = [F.col(group), *order, F.col(TIE)]
    ordered = source.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(TIE, *drop)
    names, at = ordered.columns, ordered.columns.index(group)

    def numbered(batches: Iterator) -> Iterator:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            column = batch.column(at)
            if column[0].as_py() != last:
                seen = 0
            cuts = _starts(column)
            nth = np.arange(rows, dtype=np.int64)
            begins = np.concatenate([[0], cuts])
            sizes = np.diff(np.append(begins, rows))
            nth -= np.repeat(begins, sizes)
            nth[: sizes[0]] += seen
            last, seen = column[rows - 1].as_py(), int(nth[-1]) + 1
            extra = [pa.array(np.full(rows, part, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "_part", "_nth"])

    more = [T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType())]
    table = kept(ordered.mapInArrow(numbered, T.StructType([*ordered.schema.fields, *more])), "ranked")
    parts = table.groupBy(group, "_part").agg(F.count("*").alias("n")).groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("_part", "n"))).alias("parts")
    )
    earlier = F.transform(
        "parts",
        lambda p: F.struct(
            p["_part"].alias("_part"),
            F.aggregate(
                F.filter("parts", lambda q: q["_part"] < p["_part"]), F.lit(0).cast("long"), lambda a, q: a + q["n"]
            ).alias("before"),
        ),
    )
    spread = parts.where(F.size("parts") > 1).select(group, F.explode(earlier).alias("p")).select(group, "p.*")
    placed = table.join(F.broadcast(spread), [group, "_part"], "left")
    return placed.select(*names, (F.col("_nth") + F.coalesce("before", F.lit(0))).alias("pos"))

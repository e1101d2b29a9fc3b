"""Ratios and exact distribution summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return share(F.lit(100.0) * part, whole)


def value_counts(df: DataFrame, value: str, *by: str) -> DataFrame:
    """One row per distinct value (and ``by`` key) with its count ``n``; NULL values dropped.

    Day counts, ages and prescription counts take few distinct values however
    many rows there are. Exact quantiles are then taken from this table, so the
    last task merges distinct values and never one map per input task.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def mean_of(value: str, n: str = "n") -> Column:
    """Mean of a counted value; NULL when there are no rows."""
    total = F.sum(F.col(value) * F.col(n)).cast("double")
    return F.try_divide(total, F.sum(n).cast("double"))


def mean_of_known(value: str, n: str = "n") -> Column:
    """Mean of a counted value over the rows where it is not NULL."""
    known = F.sum(F.when(F.col(value).isNotNull(), F.col(n))).cast("double")
    return F.try_divide(F.sum(F.col(value) * F.col(n)).cast("double"), known)


def quantile_of(value: str, q: float, n: str = "n") -> Column:
    """Exact, linearly interpolated quantile of a counted value."""
    return F.percentile(F.col(value), F.lit(q), F.col(n))


def six_numbers(df: DataFrame, value: str, suffix: str) -> DataFrame:
    """One row: min, p25, median, p75, max and mean of ``value``, NULLs ignored."""
    return value_counts(df, value).agg(
        F.min(value).cast("bigint").alias(f"min_{suffix}"),
        quantile_of(value, 0.25).alias(f"p25_{suffix}"),
        quantile_of(value, 0.5).alias(f"median_{suffix}"),
        quantile_of(value, 0.75).alias(f"p75_{suffix}"),
        F.max(value).cast("bigint").alias(f"max_{suffix}"),
        mean_of(value).alias(f"mean_{suffix}"),
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side.

    They are stacked and folded, so no join of two unrelated sides is planned.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])

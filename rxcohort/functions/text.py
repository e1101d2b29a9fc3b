"""Name matching."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(name: Column, keywords: Iterable[str]) -> Column:
    """Case-insensitive literal substring match on any keyword; NULL for a NULL name."""
    lowered = F.lower(name)
    tests = [lowered.contains(F.lit(k.lower())) for k in keywords]
    if not tests:
        return F.lit(False)
    return reduce(Column.__or__, tests)


def first_match(name: Column, keywords: Iterable[str]) -> Column:
    """The first keyword, in the given order, that the name contains; else NULL."""
    label = F.lit(None).cast("string")
    for keyword in reversed(list(keywords)):
        label = F.when(contains_any(name, [keyword]), F.lit(keyword)).otherwise(label)
    return label

"""Spans of pattern matches in whole texts, with DataFrame functions only.

Start and end are code points, the end exclusive. Patterns are Java patterns
written so that a match takes time in proportion to the text: quantifiers are
possessive where nothing they take could be needed later, and runs are entered
at their start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 24  # characters kept from before a match
_BLOCK = 256

SPAN = "struct<kind:string,start:int,end:int,value:string,before:string>"


def _running(values: Column, start: Column) -> Column:
    """Running sums of an array, ``start`` included."""
    empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, value: Column) -> Column:
        now = state["at"] + value
        return F.struct(now.alias("at"), F.array_append(state["out"], now).alias("out"))

    return F.aggregate(values, empty, step, lambda state: state["out"])


def running_sums(values: Column) -> Column:
    """Running sums of an int array, in blocks so that long arrays aren't copied at each step."""
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK)).cast("int"))
    blocks = F.transform(numbers, lambda i: F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    ends = _running(sums, F.lit(0))
    parts = F.transform(
        F.arrays_zip(blocks.alias("b"), sums.alias("s"), ends.alias("e")), lambda z: _running(z["b"], z["e"] - z["s"])
    )
    return F.flatten(parts)


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """``df`` with one column ``_<kind>`` of all matches for each pattern, as spans.

    Matches are leftmost and don't overlap within a kind. ``hints`` may name a
    string without which a kind cannot match, to pass over texts quickly.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def found(kind: str) -> Column:
        every = F.regexp_extract_all(whole, F.lit(patterns[kind]), F.lit(0))
        none = F.array().cast("array<string>")
        return F.when(whole.contains(hints[kind]), every).otherwise(none) if kind in hints else every

    def gaps(kind: str) -> Column:
        return F.when(F.size(f"_{kind}") > 0, F.split(whole, patterns[kind], -1))

    def spans(kind: str) -> Column:
        values, before = F.col(f"_{kind}"), F.col(f"_{kind}_gaps")
        steps = F.transform(values, lambda v, i: F.length(F.get(before, i)) + F.length(v))
        ends = F.col(f"_{kind}_ends")
        one = lambda v, i: F.struct(
            F.lit(kind).alias("kind"),
            (F.get(ends, i) - F.length(v)).alias("start"),
            F.get(ends, i).alias("end"),
            v.alias("value"),
            F.right(F.get(before, i), F.lit(CONTEXT)).alias("before"),
        )
        if steps_only[0]:
            return F.when(F.size(values) > 0, running_sums(steps))
        return F.when(F.size(values) > 0, F.transform(values, one)).otherwise(F.array().cast(f"array<{SPAN}>"))

    kinds = list(patterns)
    out = df.select("*", *[found(k).alias(f"_{k}") for k in kinds])
    out = out.select("*", *[gaps(k).alias(f"_{k}_gaps") for k in kinds])
    steps_only = [True]
    out = out.select("*", *[spans(k).alias(f"_{k}_ends") for k in kinds])
    steps_only[0] = False
    rest = [c for c in out.columns if c not in {f"_{k}{x}" for k in kinds for x in ("", "_gaps", "_ends")}]
    return out.select(*[F.col(f"`{c}`") for c in rest], *[spans(k).alias(f"_{k}") for k in kinds])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Spans sorted by start, then kind in the order of ``kinds``."""
    order = F.array(*map(F.lit, kinds))

    def key(s: Column) -> Column:
        return F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s.alias("s"))

    return F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["s"])


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def count_of(spans: str, kind: str) -> Column:
    """How many spans of a column are of a kind, as a long."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

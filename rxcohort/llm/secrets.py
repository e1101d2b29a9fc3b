"""Secrets in texts and how widely each is copied, with DataFrame functions only.

Every candidate value is hashed; hashes are aggregated over the whole corpus by
distinct repositories and distinct owners. A value that several owners have is
a copied example; one that a single owner has and that looks random is treated
as live. Besides the base matches, long random tokens without a telling name
are candidates too and are added where they are live.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import kept
from rxcohort.llm.spans import by_start, clear_of, count_of, listed, with_matches

KINDS = ["assign", "access", "hex"]
WIDE = "token"
EXAMPLE_OWNERS = 3  # from so many owners on, a value is an example
LIVE_LENGTH, LIVE_DISTINCT = 16, 8  # shortest live value, and fewest distinct characters in it

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "[0-9a-f]{24,}+",
    WIDE: r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
HINTS = {"access": "AKIA"}

# Parts of names that only examples have.
DUMMY = r"(?i)(example|sample|dummy|test|placeholder|changeme|your_|xxxx|12345)"


def secret_value(s: Column) -> Column:
    """What is secret in a span: the assigned value, or all of it."""
    return F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])


def _valid(kind: str, s: Column) -> Column:
    if kind == "assign":
        return F.length(secret_value(s)) >= 6
    if kind == WIDE:
        v = s["value"]
        return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return F.lit(True)


def looks_live(value: Column) -> Column:
    """Long, varied, with digits and letters, and not named as an example."""
    return (
        (F.length(value) >= LIVE_LENGTH)
        & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike(DUMMY)
    )


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_wide``: base spans by start, and long tokens clear of them."""
    found = with_matches(docs, text, PATTERNS, HINTS)
    checked = found.withColumns({f"_{k}": F.filter(f"_{k}", partial(_valid, k)) for k in PATTERNS})
    joined = checked.withColumn("_base", by_start(F.concat(*[f"_{k}" for k in KINDS]), KINDS))
    wide = joined.withColumn("_wide", clear_of(F.col(f"_{WIDE}"), F.col("_base")))
    return wide.drop(*[f"_{k}" for k in PATTERNS])


def ownership(candidates: DataFrame) -> DataFrame:
    """secret, repositories, owners: over how many of each a hash is spread.

    Rows (secret, repository, owner) are made distinct first, with a map-side
    step, so a value that stands in a third of all documents moves as one row
    for each of its places and task.
    """
    places = candidates.select("secret", "repository", "owner").distinct()
    return places.groupBy("secret").agg(
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners")
    )


def find_secrets(
    docs: DataFrame,
    owner: Column,
    repository: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    ``owner`` and ``repository`` say whose document it is and where it lies; a
    null counts as one more owner or repository. n_live and n_example count
    base and added candidates by the verdict on their value. Rows with null
    ids, repeated rows and empty tables are treated like any others; a null
    text has no spans; other columns are not looked at.
    """
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
    )
    found = with_candidates(chosen).drop("text").withColumn("row", F.monotonically_increasing_id())
    table = kept(found, "candidates")
    each = (
        table.where((F.size("_base") > 0) | (F.size("_wide") > 0))
        .select("row", "owner", "repository", F.explode(F.concat("_base", "_wide")).alias("s"))
        .select(
            "row", "owner", "repository",
            F.struct("s.kind", "s.start", "s.end").alias("s"),
            F.unhex(F.sha2(secret_value(F.col("s")).cast("binary"), 256)).alias("secret"),
            looks_live(secret_value(F.col("s"))).alias("live"),
        )
    )
    spread = kept(ownership(each), "ownership")
    example = F.col("owners") >= example_owners
    live = ~example & (F.col("owners") == 1) & F.col("live")
    judged = each.join(spread, "secret").select("row", "s", live.alias("live"), example.alias("example"))
    verdicts = kept(
        judged.groupBy("row").agg(
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum(F.col("example").cast("long")).alias("n_example"),
            F.collect_list(F.when(F.col("live") & (F.col("s.kind") == WIDE), F.col("s"))).alias("added"),
        ),
        "verdicts",
    )
    out = table.drop("_wide", "owner", "repository").join(verdicts, "row", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    plain = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(
        "doc_id",
        *[count_of("_base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(by_start(F.concat(plain, F.coalesce("added", none)), [*KINDS, WIDE])).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )

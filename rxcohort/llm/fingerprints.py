r"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is a set of paragraphs (lines; a long line is cut at the end of a
sentence), and a paragraph a digest of 43 bits with a check value of 20 bits
behind them. A sketch has three blocks of eight cells; a digest goes to one
cell of each block, where a count and the XOR of the digests are kept. Two
sketches are subtracted cell by cell, which leaves the digests that only one
of the texts has, and these are peeled off: a cell with one digest left, as
its check value tells, gives it away, it is taken out of its other cells, and
so on. Where peeling gets stuck or does not end with empty cells, the digests
of that comparison are dealt by three of their bits to eight sketches, eight times
the cells, and compared again, until all differences are found.

Only SQL functions and DataFrame operations are used. All work on one row is
in proportion to its text; rows are shuffled once, to meet the next document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxcohort.llm.common import kept

BLOCKS, SLOT_BITS = 3, 3
SLOTS = 1 << SLOT_BITS
CELLS = BLOCKS * SLOTS
DIGEST_BITS, CHECK_BITS = 43, 20
FACTOR, MODULUS = 1_000_003, 1_048_573  # of the check value
BITS = 3  # of a digest that deal it to one of eight larger sketches, the highest ones first
BUCKETS = 4  # of ids, for each shuffle partition

# A line, cut after the first end of a sentence past 160 characters (320 without one), and what ends it.
PARAGRAPH = r"[^\n]{1,160}[^\n.!?]{0,160}[.!?\n]*|\n+"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paragraphs(text: str) -> Column:
    """Digests with check values of the distinct paragraphs of a text column; line ends at their end don't count."""
    parts = F.regexp_extract_all(F.col(text), F.lit(PARAGRAPH), F.lit(0))
    bare = F.filter(F.transform(parts, lambda p: F.rtrim(p, F.lit("\n"))), lambda p: p != "")
    number = F.transform(bare, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 11), 16, 10).cast("long"))
    digest = F.transform(number, lambda n: n.bitwiseAND(F.lit((1 << DIGEST_BITS) - 1)))
    return F.array_distinct(F.transform(digest, lambda d: F.shiftleft(d, CHECK_BITS).bitwiseOR(d * FACTOR % MODULUS)))


def _sketch(keys: str) -> str:
    """Cells (n, key, and the mask and bits of the digests that go there) of an array of distinct digests."""
    blocks = []
    for block in range(BLOCKS):
        at = CHECK_BITS + SLOT_BITS * block
        mask = f"{SLOTS - 1 << at}L"
        own = f"filter({keys}, k -> (k & {mask}) = bits)"
        blocks.append(
            f"transform(sequence(0L, {mask}, {1 << at}L), bits -> named_struct('own', {own}, 'mask', {mask}, 'bits', bits))"
        )
    folded = "named_struct('n', size(x.own), 'key', aggregate(x.own, 0L, (a, k) -> a ^ k), 'mask', x.mask, 'bits', x.bits)"
    return f"transform(concat({', '.join(blocks)}), x -> {folded})"


def fingerprint(keys: str) -> Column:
    """The sketch of a column of digests as hex: count (4 digits) and XOR of the digests (16) of each cell."""
    shown = "concat(lpad(hex(x.n & 65535), 4, '0'), lpad(hex(x.key), 16, '0'))"
    return F.expr(f"lower(array_join(transform({_sketch(keys)}, x -> {shown}), ''))")


def _peeled(a: str, b: str) -> str:
    """Digests that one of two arrays only has, found from their sketches; NULL if peeling does not end with empty cells.

    Those of ``b`` have all bits turned, so that they are negative.
    """
    less = "named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'mask', x.mask, 'bits', x.bits)"
    cells = f"zip_with({_sketch(a)}, {_sketch(b)}, (x, y) -> {less})"
    check = f"shiftright(x.key, {CHECK_BITS}) * {FACTOR}L % {MODULUS}L = (x.key & {(1 << CHECK_BITS) - 1}L)"
    alone = f"filter(s.cells, x -> (x.n = 1 OR x.n = -1) AND (x.key & x.mask) = x.bits AND {check})"
    pure = f"array_distinct(transform({alone}, x -> IF(x.n = 1, x.key, ~x.key)))"
    plain = "(p ^ shiftright(p, 63))"
    taken = _let(
        "own",
        f"filter(pure, p -> ({plain} & x.mask) = x.bits)",
        "IF(size(own) = 0, x, named_struct("
        "'n', x.n - aggregate(own, 0, (a, p) -> IF(p < 0, a - 1, a + 1)), "
        f"'key', x.key ^ aggregate(own, 0L, (a, p) -> a ^ {plain}), 'mask', x.mask, 'bits', x.bits))",
    )
    step = _let(
        "pure",
        pure,
        "IF(size(pure) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), "
        f"named_struct('cells', transform(s.cells, x -> {taken}), 'found', concat(s.found, pure), 'go', true))",
    )
    start = f"named_struct('cells', {cells}, 'found', CAST(array() AS ARRAY<BIGINT>), 'go', true)"
    empty = "forall(s.cells, x -> x.n = 0 AND x.key = 0)"
    # Every step but the last finds a digest, and a sketch that can be peeled holds no more than CELLS.
    return f"aggregate(sequence(1, {CELLS}), {start}, (s, i) -> IF(s.go, {step}, s), s -> IF({empty}, s.found, NULL))"


def differences(pairs: DataFrame) -> DataFrame:
    """Digests that only one side of a pair has: the other columns of ``pairs``, only_a and only_b, in parts.

    ``pairs`` has arrays a and b of distinct digests. A
    pair whose sketches cannot be peeled comes back in up to eight parts for
    each time it was retried; parts without differences are left out. Each
    retry is a job over the rows that still need it.
    """
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    todo, done, level = pairs, [], 0
    while True:
        tried = todo.withColumn("found", F.expr(_peeled("a", "b")))
        stuck = F.col("found").isNull()
        tried = kept(tried.select(*keys, *[F.when(stuck, F.col(c)).alias(c) for c in ("a", "b")], "found"), "tried")
        sides = ("filter(found, k -> k >= 0) AS only_a", "transform(filter(found, k -> k < 0), k -> ~k) AS only_b")
        done.append(tried.where(F.size("found") > 0).selectExpr(*keys, *sides))
        left = tried.where("found IS NULL")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)

        def part(side: str) -> str:
            shift = DIGEST_BITS + CHECK_BITS - BITS * (level + 1)
            return f"filter({side}, k -> (shiftright(k, {shift}) & {2**BITS - 1}) = p) AS {side}"

        split = left.select(*keys, "a", "b", F.explode(F.sequence(F.lit(0), F.lit(2**BITS - 1))).alias("p"))
        todo = split.selectExpr(*keys, part("a"), part("b"))
        level += 1


def _bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ascending ids that part the documents into about equal buckets: at most one per bucket."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets)).alias("cuts")).first()[0]
    return sorted(set(cuts or []))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are below ``value``, found among every n-th bound and then among n; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    every, coarse = F.lit(bounds), F.lit(bounds[step - 1 :: step])
    skipped = F.size(F.filter(coarse, lambda b: b < value)) * step
    rest = F.size(F.filter(F.slice(every, skipped + 1, F.lit(step)), lambda b: b < value))
    return F.when(value.isNull(), -1).otherwise(skipped + rest)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with the ``columns`` of the next document in descending doc_id as next_<column>.

    After the last comes the first. Rows without an id come last, and rows
    that share an id ascend by text. Documents are dealt to buckets of ids,
    and the first row of a bucket is also sent to the bucket before it, so a
    row finds the next one where it is. What the driver sees is an id per
    bucket.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, buckets)
    dealt = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    highest = sorted((r.bucket, r.top) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    # The bucket below b continues b; the lowest one is continued by the highest.
    heads = [(top, highest[(at + 1) % len(highest)][0]) for at, (_, top) in enumerate(highest)]
    listed = spark.createDataFrame(heads, "top long, target int")
    ids = [top for top, _ in heads if top is not None]
    tops = dealt.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) if heads else dealt.limit(0)
    copies = tops.join(F.broadcast(listed), F.col("doc_id").eqNullSafe(F.col("top"))).drop("top", "bucket")
    both = dealt.withColumn("copy", F.lit(False)).unionByName(
        copies.withColumnRenamed("target", "bucket").withColumn("copy", F.lit(True))
    )
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    led = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("copy")).drop("copy", "bucket")


def likeness(differing: Column, sizes: Column) -> Column:
    """Shared over all distinct paragraphs of two texts; 1 where neither has any."""
    return F.when(sizes == 0, 1.0).otherwise((sizes - differing) / (sizes + differing))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of an edited text, and how alike they and the next document's are.

    In the edited text the last half of the code points (rounded down) are
    replaced by as many from the beginning of the next document (all, if it is
    shorter), in descending id, the first after the last. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_paragraphs, and how many paragraphs only the document
    (n_removed) and only the edited text (n_added) has.

    Null texts are empty; two empty texts are alike. Whole texts count,
    however long. Documents without an id come last, and rows that share an id
    ascend by text; repeated rows each have a row. A single document follows
    itself. An empty table gives an empty table; other columns are not looked
    at.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    led = with_next(slim.withColumn("own", paragraphs("text")), ["text", "own"])
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n_chars - half), F.substring("next_text", F.lit(1), half)
    )
    base = kept(
        led.select("doc_id", n_chars.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            "own",
            paragraphs("edited").alias("edited_own"),
            "next_own",
        ),
        "digests",
    )
    sides = F.explode(F.array(
        F.struct(F.lit("edited").alias("kind"), F.col("edited_own").alias("b")),
        F.struct(F.lit("next").alias("kind"), F.col("next_own").alias("b")),
    )).alias("other")
    pairs = base.select("row", F.col("own").alias("a"), sides).select("row", "a", "other.*")

    def found(kind: str, side: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.size(side)).otherwise(0))

    counts = differences(pairs).groupBy("row").agg(
        found("edited", "only_a").alias("n_removed"), found("edited", "only_b").alias("n_added"),
        (found("next", "only_a") + found("next", "only_b")).alias("apart"),
    )
    sized = base.select(
        "row", "doc_id", "n_chars", "edited_sha256", "own", "edited_own", F.size("next_own").alias("next_size")
    )
    met = sized.join(counts, "row", "left").na.fill(0, ["n_removed", "n_added", "apart"])
    own, other = F.size("own"), F.size("edited_own")
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint("own").alias("fingerprint"),
        fingerprint("edited_own").alias("edited_fingerprint"),
        likeness(F.col("n_removed") + F.col("n_added"), own + other).alias("near_edited"),
        likeness(F.col("apart"), own + F.col("next_size")).alias("near_next"),
        own.cast("long").alias("n_paragraphs"),
        "n_removed",
        "n_added",
    )

"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Coarse centroids cut the unit sphere into inverted lists; a vector is stored
in the list of its nearest centroid, its residual coded by subspace. A vector
probes every list that could hold a partner: two unit vectors with cosine
``c`` are ``d = sqrt(2 - 2c)`` apart, so a partner lies in another list only if
the plane halfway between the two centroids is within ``d``. Stored codes are
compared by table look-up; a pair whose looked-up distance exceeds ``d`` by
more than the stored vector's own coding error cannot be close enough. What
is left is decided by the exact cosine. All three steps lose no pair, so
recall against brute force is 1, whatever sample the centroids came from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.llm.common import kept
from rxcohort.llm.components import connected

SAMPLE = 20_000  # vectors that centroids and codes are trained on, at most
LISTS = 64
SUBSPACES, CODES = 8, 256
STORED, PROBING = 512, 2048  # vectors of a list that meet in one task


@dataclass(frozen=True)
class Quantizer:
    """Coarse centroids (lists x dim) and code words (subspaces x codes x width)."""

    centroids: np.ndarray
    words: np.ndarray

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, and how far the row is from the plane to each other one."""
        squared = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        own = squared.argmin(1)
        gap = np.sqrt(((self.centroids[:, None] - self.centroids[None]) ** 2).sum(2))
        far = (squared - squared[np.arange(len(x)), own][:, None]) / np.maximum(2 * gap[own], 1e-12)
        return own, far

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows as (row, subspace, width), zeros appended where the width doesn't divide the dimension."""
        count, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, count * width - x.shape[1]))).reshape(len(x), count, width)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distance of each row's part to each code word: (row, subspace, code)."""
        parts = self.split(residual)
        cross = np.einsum("nsw,scw->nsc", parts, self.words)
        return (parts**2).sum(2)[:, :, None] - 2 * cross + (self.words**2).sum(2)[None]

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, and the distance between the row and what its codes say."""
        codes = self.tables(residual).argmin(2).astype(np.uint8)
        said = self.words[np.arange(self.words.shape[0])[None], codes]
        return codes, np.sqrt(((self.split(residual) - said) ** 2).sum((1, 2)))


def k_means(x: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Centroids of Lloyd's rounds, from evenly spaced rows."""
    centroids = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
        size = np.bincount(own, minlength=count)
        for dim in range(x.shape[1]):
            total = np.bincount(own, x[:, dim], count)
            centroids[size > 0, dim] = total[size > 0] / size[size > 0]
    return centroids


def train(x: np.ndarray, lists: int = LISTS) -> Quantizer:
    centroids = k_means(x, max(1, min(lists, len(x) // 8)))
    own = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
    residual = x - centroids[own]
    width = -(-x.shape[1] // SUBSPACES)
    parts = np.pad(residual, ((0, 0), (0, SUBSPACES * width - x.shape[1]))).reshape(len(x), SUBSPACES, width)
    codes = min(CODES, len(x))
    return Quantizer(centroids, np.stack([k_means(parts[:, s], codes, 6) for s in range(SUBSPACES)]))


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _normed(flat.reshape(len(column), -1))


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length one. They are first divided by a power of two near their largest part, so nothing overflows or vanishes."""
    _, power = np.frexp(np.abs(x).max(1))
    # Two steps, as the power itself may be out of range.
    x = np.ldexp(np.ldexp(x, -(power // 2)[:, None]), -(power - power // 2)[:, None])
    return x / np.sqrt((x**2).sum(1))[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that may link: row, group (label and dimension), vector as doubles."""
    whole = F.transform("embedding", lambda v: v.cast("double"))
    plain = vectors.where("label is not null and embedding is not null and vec_id is not null and size(embedding) > 0")
    checked = plain.select("row", F.struct(F.col("label"), F.size("embedding").alias("dim")).alias("group"), whole.alias("x"))
    unfit = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return checked.where(~unfit & F.exists("x", lambda v: v != 0))


def _placed(vectors: DataFrame, models: dict[int, Quantizer], distance: float) -> DataFrame:
    """Each vector once as stored (probe false) and once for each list it probes."""

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            dims = batch.column(1).field("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                own, far = models[int(dim)].lists(_unit(part.column(2)))
                probe = far <= distance + 1e-9
                at, to = np.nonzero(probe)
                every = pa.array(np.concatenate([np.arange(len(own)), at]))
                taken = part.take(every)
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken.columns,
                        pa.array(np.concatenate([own, to]).astype(np.int32)),
                        pa.array(np.arange(len(every)) >= len(own)),
                    ],
                    ["row", "group", "x", "list", "probe"],
                )

    dim_type = vectors.schema["group"].dataType.simpleString()
    return vectors.mapInArrow(rows, f"row long, group {dim_type}, x array<double>, list int, probe boolean")


def _compared(models: dict[int, Quantizer], cosine: float):
    """For one block of stored and one of probing vectors: hits of each probing one, and links that connect them."""
    distance = np.sqrt(max(0.0, 2 - 2 * cosine))

    def meet(key: tuple, stored: pa.Table, probing: pa.Table) -> pa.Table:
        empty = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "hits": pa.array([], pa.int64())}
        if not stored.num_rows or not probing.num_rows:
            return pa.table(empty)
        y, x = (_unit(t.column("x").combine_chunks()) for t in (stored, probing))
        model = models[y.shape[1]]
        centre = model.centroids[stored.column("list")[0].as_py()]
        codes, error = model.code(y - centre)
        limit = (distance + error + 1e-6) ** 2
        y_row, x_row = (t.column("row").to_numpy() for t in (stored, probing))
        order = np.argsort(y_row, kind="stable")
        y, codes, limit, y_row = y[order], codes[order], limit[order], y_row[order]
        a, b, hits = [], [], []
        for start in range(0, len(x), 256):
            tables = model.tables(x[start : start + 256] - centre)
            looked_up = sum(tables[:, s, codes[:, s]] for s in range(codes.shape[1]))
            px, py = np.nonzero(looked_up <= limit)
            exact = np.einsum("nd,nd->n", x[start + px], y[py]) >= cosine
            px, py = start + px[exact], py[exact]
            other = x_row[px] != y_row[py]
            px, py = px[other], py[other]
            if len(px):
                who, first, count = np.unique(px, return_index=True, return_counts=True)
                a.append(x_row[who]), b.append(y_row[py[first]]), hits.append(count)
                # Partners of one vector are linked through the first of them.
                ties = np.unique(np.stack([np.repeat(y_row[py[first]], count), y_row[py]]), axis=1)
                ties = ties[:, ties[0] != ties[1]]
                a.append(ties[0]), b.append(ties[1]), hits.append(np.zeros(ties.shape[1], np.int64))
        if not a:
            return pa.table(empty)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "hits": np.concatenate(hits).astype(np.int64)})

    return meet


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, lists: int = LISTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Needs vec_id, embedding (an array of numbers) and label; other columns are
    not looked at. Vectors link when label and dimension are equal and the
    cosine in double precision is at least ``cosine``. A null id, label or
    vector, an empty or zero vector, and one with a null or non-finite
    component link with nothing and are kept. Repeated rows are vectors of
    their own. A list that holds very many vectors is met in blocks of bounded
    size; per block and vector only a count and the links that connect it
    leave the task, so a group of copies does not come out as all its pairs.
    """
    chosen = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", F.monotonically_increasing_id().alias("row")
    )
    table = kept(chosen, "vectors")
    fit_on = usable(table)
    some = fit_on.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("x").collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(len(r.x), []).append(r.x)
    models = {}
    for dim, xs in by_dim.items():
        x = np.array(xs, np.float64)
        models[dim] = train(_normed(x), lists)
    for row in fit_on.select(F.col("group.dim").alias("dim")).distinct().collect():
        if row.dim not in models:  # a dimension too rare for the sample: one list, one code word
            width = -(-row.dim // SUBSPACES)
            models[row.dim] = Quantizer(np.zeros((1, row.dim)), np.zeros((SUBSPACES, 1, width)))
    distance = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    placed = kept(_placed(fit_on, models, distance), "placed")
    sizes = kept(
        placed.groupBy("group", "list").agg(
            F.ceil(F.count(F.when(~F.col("probe"), 1)) / STORED).alias("ns"),
            F.ceil(F.count(F.when(F.col("probe"), 1)) / PROBING).alias("np"),
        ),
        "sizes",
    )
    sized = placed.join(sizes.where("ns > 0"), ["group", "list"])
    salt = F.xxhash64("row")
    stored = sized.where("not probe").select(
        "group", "list", "row", "x", F.pmod(salt, "ns").alias("s"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("p")
    )
    probing = sized.where("probe").select(
        "group", "list", "row", "x", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("s"), F.pmod(salt, "np").alias("p")
    )
    block = ["group", "list", "s", "p"]
    probing = probing.toDF(*probing.columns)  # columns of its own
    met = stored.groupBy(*block).cogroup(probing.groupBy(*block))
    found = kept(met.applyInArrow(_compared(models, cosine), "a long, b long, hits long"), "found")
    counts = kept(found.where("hits > 0").groupBy(F.col("a").alias("row")).agg(F.sum("hits").alias("n_links")), "counts")
    roots = connected(found, "a", "b")
    ids = table.select("row", "vec_id")
    members = kept(roots.join(ids, roots.node == ids.row).select("row", "vec_id", "root"), "members")
    first = kept(members.groupBy("root").agg(F.min("vec_id").alias("component_id")), "first")
    named = kept(members.join(first, "root").select("row", "component_id"), "named")
    out = ids.join(counts, "row", "left").join(named, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )

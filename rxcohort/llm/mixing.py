"""Mixing documents to target weights of domains, with soft membership.

A classifier trained from a labelled table gives every document a posterior
over domains. Document rates (how often a document is to be seen, zero or
more) are then fitted by projected-gradient least squares so that each
domain's expected tokens, the sum of rate x tokens x posterior, match the
targets. A rate depends only on the document's posterior and on the residuals
of all earlier steps, a few numbers per step, so a step is one distributed
sum in which every task replays the steps so far; nothing per document is
kept between steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxcohort.llm.bags import SLICE, Weights, hashed
from rxcohort.llm.common import in_slices, in_small_batches, kept, unused
from rxcohort.llm.features import Matrix, sampled, telling

LABELLED = 12_000  # labelled documents at most, for training the classifier
LEAST_SHARE = 1e-3  # a domain with less of the expected tokens counts as absent


@dataclass(frozen=True)
class Classifier:
    """Log-linear weights by feature, and biases, one number per domain."""

    domains: list[str]
    weights: Weights
    bias: np.ndarray

    def posteriors(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights.sums(texts, table)
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_classifier(rows: list[tuple[str, np.ndarray]], domains: list[str], steps: int = 200, decay: float = 1e-4) -> Classifier:
    """Softmax regression by full-batch Adam; without rows every posterior is uniform."""
    groups = [[f for d, f in rows if d == domain] for domain in domains]
    if not rows:
        return Classifier(domains, Weights(np.empty(0, np.uint32), np.zeros((0, len(domains)))), np.zeros(len(domains)))
    vocabulary = telling(groups)
    x = Matrix([f for g in groups for f in g], vocabulary)
    truth = np.repeat(np.arange(len(domains)), [len(g) for g in groups])
    target = np.eye(len(domains))[truth]
    w = np.zeros((len(vocabulary) + 1, len(domains)))
    w[-1] = np.log(target.mean(0) + 1e-4)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.stack([x.times(w[:-1, k]) for k in range(len(domains))], axis=1) + w[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        miss = (p / p.sum(1, keepdims=True) - target) / len(target)
        slope = np.stack([np.append(x.transposed_times(miss[:, k]), miss[:, k].sum()) for k in range(len(domains))], axis=1)
        slope[:-1] += decay * w[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Classifier(domains, Weights(vocabulary, w[:-1]), w[-1])


def train(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], doc_id: str, text: str) -> Classifier:
    """Fit on a bounded sample of labelled documents, by hash of the id.

    ``domain`` is a column of ``labels`` that names a row's domain. Label rows
    without an id or with another domain are ignored; of several for an id the
    alphabetically first domain counts.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.cast("string").alias("domain"))
    one = named.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(
        F.min("domain").alias("domain")
    )
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return fit_classifier(sampled(docs, picked, doc_id, text, hashed), domains)


def with_posteriors(docs: DataFrame, model: Classifier, text: str, tokens: str, posterior: str) -> DataFrame:
    """``docs`` with its number of words and its posterior over domains."""
    names, at = docs.columns, docs.columns.index(text)

    def rows(batches: Iterator) -> Iterator:
        table = model.weights.table()
        for batch in in_slices(batches, octets=SLICE):
            texts = batch.column(at).to_pylist()
            counts = [len((t or "").encode().split()) for t in texts]
            ps = pa.array(list(model.posteriors(texts, table)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), ps], [*names, tokens, posterior])

    more = [T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))]
    return in_small_batches(docs).mapInArrow(rows, T.StructType([*docs.schema.fields, *more]))


@dataclass(frozen=True)
class Rates:
    """The steps taken, from which a document's rate follows from its posterior."""

    steps: list[np.ndarray]
    least: float = 0.0  # no rate goes below

    def of(self, posterior: np.ndarray) -> np.ndarray:
        rate = np.ones(len(posterior))
        for step in self.steps:
            rate = np.maximum(self.least, rate - posterior @ step)
        return rate


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(table: DataFrame, rates: Rates, width: int, squares: bool) -> np.ndarray:
    """Expected tokens by domain at these rates; with ``squares``, sums of tokens x posterior x posterior."""

    def rows(batches: Iterator) -> Iterator:
        total = np.zeros((width, width) if squares else width)
        for batch in batches:
            p, n = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            total += (p * n[:, None]).T @ p if squares else (n * rates.of(p)) @ p
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    parts = table.select("n_tokens", "posterior").mapInArrow(rows, "i int, v double")
    found = {r.i: r.v for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}
    size = width * width if squares else width
    out = np.array([found.get(i, 0.0) for i in range(size)])
    return out.reshape(width, width) if squares else out


def fit_rates(
    table: DataFrame, shares: np.ndarray, tokens: float | None = None, least: float = 0.0, rounds: int = 40, close: float = 1e-4
) -> tuple[Rates, np.ndarray, np.ndarray]:
    """Projected gradient from rate 1 for every document: the rates, what they give, and the targets in tokens.

    ``table`` has n_tokens and posterior. ``shares`` are target weights; a
    domain that is absent (under ``LEAST_SHARE`` of the expected tokens) gets
    none and the others share its weight, with a warning. Without ``tokens``
    the total is the smallest for which no present domain has to shrink. Errors
    are weighted by the inverse of the sums of tokens x posterior x posterior,
    in which a full step is never too long and meets all targets at once where
    no rate is held at ``least``. It ends when no domain is off by more than
    ``close`` of all tokens; when ``rounds`` steps do not get there, as with
    targets that no rates can meet, a warning says how far off the worst is.
    """
    width = len(shares)
    now = _sums(table, Rates([]), width, False)
    present = now > LEAST_SHARE * max(now.sum(), 1.0)
    if (~present & (shares > 0)).any() and now.sum() > 0:
        warnings.warn(f"target domains at {np.flatnonzero(~present & (shares > 0)).tolist()} are absent; the others share their weight")
    wanted = np.where(present, shares, 0.0)
    if wanted.sum() <= 0:
        return Rates([], least), now, now
    wanted = wanted / wanted.sum()
    if tokens is None:
        tokens = max(now[d] / wanted[d] for d in range(width) if wanted[d] > 0)
    target = wanted * tokens
    gram = _sums(table, Rates([]), width, True)
    weight = np.linalg.inv(gram + 1e-6 * np.trace(gram) * np.eye(width))
    steps: list[np.ndarray] = []
    while (off := np.abs(now - target).max() / target.sum()) > close and len(steps) < rounds:
        steps.append(weight @ (now - target))
        now = _sums(table, Rates(steps, least), width, False)
    if off > close:
        warnings.warn(f"after {rounds} steps a domain is off its target by {off:.2g} of all tokens")
    return Rates(steps, least), now, target


def _rate(rates: Rates, posterior: str, width: int, df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rate in column ``name``."""
    names, at = df.columns, df.columns.index(posterior)

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            rate = rates.of(_matrix(batch.column(at), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*names, name])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number of copies whose mean is the rate: the fraction is rounded by a hash of the id."""
    chance = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + chance).cast("int")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: Mapping[str, float],
    tokens: float | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_tokens, posterior, rate, copies.

    posterior follows the order of ``targets``. Documents without words have
    no tokens and move no domain, but get a rate like any other. Rows with
    null ids or texts and repeated rows are treated like any others; an empty
    table gives an empty table, and without labels every rate is the same.
    Other columns are not looked at.
    """
    domains = list(targets)
    model = train(docs, labels, domain, domains, doc_id, text)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = kept(with_posteriors(chosen, model, "text", "n_tokens", "posterior").drop("text"), "posteriors")
    rates, _, _ = fit_rates(table, np.array([targets[d] for d in domains], float), tokens)
    return _rate(rates, "posterior", len(domains), table, "rate").withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: Mapping[str, float],
    least: float = 0.0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs``, each row as often as its copies say, with the same columns.

    With ``least`` at 1 no document is lost: weights are met by repeating.
    Rates are fitted on posteriors without texts; the rows get theirs in the
    pass that writes them, so no text is written in between. Columns of any
    name pass through; edge cases as in ``mix``.
    """
    domains, columns = list(targets), docs.columns
    tokens, posterior, rate, copy = (unused(columns, name) for name in ("tokens", "posterior", "rate", "copy"))
    model = train(docs, labels, domain, domains, doc_id, text)
    slim = docs.select(F.col(f"`{text}`").alias("text"))
    table = kept(with_posteriors(slim, model, "text", "n_tokens", "posterior").drop("text"), "posteriors")
    rates, _, _ = fit_rates(table, np.array([targets[d] for d in domains], float), least=least)
    scored = with_posteriors(docs, model, text, tokens, posterior).drop(tokens)
    rated = _rate(rates, posterior, len(domains), scored, rate)
    times = copies(F.col(rate), F.col(f"`{doc_id}`"))
    return rated.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)

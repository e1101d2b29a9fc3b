"""Toxicity by non-negative positive-unlabelled learning.

Logistic models are trained from confirmed toxic documents and from unlabelled
text, a mixture that holds toxic documents in the share of the class prior.
The risk of the negative class is estimated as the unlabelled risk minus the
prior times the positives' negative risk, and is held at zero or above: when
it falls below, the step goes the other way, which keeps a flexible model
from overfitting the positives.

Unlabelled documents are all documents of the training folds. They are dealt
by a hash of their ids into groups of about ``GROUP``; each group trains one
model beside the positives, and the models' weights are averaged, so the log
odds of a text are the mean over the models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxcohort.llm.common import doc_fold, in_slices, in_small_batches, kept
from rxcohort.llm.features import Matrix, features, sampled, telling

POSITIVES = 4_000  # confirmed toxic documents at most, for training
LABELLED = 10_000  # labelled documents at most, whatever the verdict, that features are chosen from
GROUP = 10_000  # unlabelled documents that train one model, about


@dataclass(frozen=True)
class Model:
    """Weights by feature, and what every text starts from."""

    weights: dict[int, float]
    bias: float

    def score(self, text: str | None) -> float:
        hits = self.weights.keys() & features(text)[0]
        z = self.bias + sum(self.weights[h] for h in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def negative_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The estimated risk of the negative class, from log odds of positives and of unlabelled rows."""
    return float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step follows, by row: derivatives of the whole risk, or, where the negative risk is below zero, of its negation."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    loss_p, loss_u = -prior * sp / len(sp), su / len(su)
    if negative_risk(zp, zu, prior) < 0:
        return -loss_p, -loss_u
    return prior * (sp - 1) / len(sp) + loss_p, loss_u


def _descend(p: Matrix, u: Matrix, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights of the features and the bias, by full-batch Adam on the non-negative risk."""
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        dp, du = slopes(p.times(w[:-1]) + w[-1], u.times(w[:-1]) + w[-1], prior)
        slope = np.append(p.transposed_times(dp) + u.transposed_times(du) + decay * w[:-1], dp.sum() + du.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def _model(vocabulary: np.ndarray, w: np.ndarray) -> Model:
    return Model(dict(zip(vocabulary.tolist(), w[:-1].tolist())), float(w[-1]))


def _untaught(prior: float) -> Model:
    """Without positives there is nothing to learn: every text scores the prior, at most 0.49."""
    share = min(max(prior, 1e-3), 0.49)
    return Model({}, float(np.log(share / (1 - share))))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """One model from the features of positives and of unlabelled rows."""
    if not positive or not unlabelled:
        return _untaught(prior)
    vocabulary = telling([positive, unlabelled])
    return _model(vocabulary, _descend(Matrix(positive, vocabulary), Matrix(unlabelled, vocabulary), prior))


def _chosen_features(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id and row, a document's features among ``vocabulary``; of rows that share an id, the least."""
    names = frozenset(vocabulary.tolist())

    def rows(batches: Iterator) -> Iterator:
        for batch in in_slices(batches):
            found = [np.array(sorted(names & features(t)[0]), "<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "row"])

    found = in_small_batches(docs).mapInArrow(rows, "doc_id long, row binary")
    return kept(found.groupBy("doc_id").agg(F.min("row").alias("row")), "unlabelled")


def fit_groups(positive: list[np.ndarray], rows: DataFrame, vocabulary: np.ndarray, prior: float, group: int = GROUP) -> Model:
    """The mean of one model for each group of ``rows`` (doc_id, row), weighted by their numbers of rows.

    Positives and features are bounded, so each task gets them whole.
    """
    count = rows.count()
    if not positive or not count:
        return _untaught(prior)
    groups = -(-count // group)

    def fit(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(row, "<u4") for row in table.sort_by("doc_id").column("row").to_pylist()]
        w = _descend(Matrix(positive, vocabulary), Matrix(own, vocabulary), prior) * (len(own) / count)
        return pa.table({"place": pa.array(np.arange(len(w)), pa.int32()), "part": w})

    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    parts = dealt.groupBy("dealt").applyInArrow(fit, "place int, part double")
    summed = parts.groupBy("place").agg(F.sum("part").alias("weight")).collect()
    return _model(vocabulary, np.array([r.weight for r in sorted(summed, key=lambda r: r.place)]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    labelled: int = LABELLED,
    group: int = GROUP,
    prior: float | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Model:
    """Fit on the training folds (crc32 of the id, modulo 5, not 0).

    Positives are documents that any of their label rows calls toxic. The
    prior is the toxic share of labelled documents unless given. Positives, and
    the labelled documents that features are chosen from, are bounded samples
    by hash of the id; unlabelled are all documents with an id, each id once.
    Labels, language, source and id are not features. Label rows without an
    id or a verdict are ignored.
    """
    verdicts = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(doc_fold() != 0)
    )
    seen = verdicts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if prior is None:
        prior = (seen.toxic or 0) / seen.n if seen.n else 0.0
    prior = min(max(prior, 1e-3), 0.9)
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    confirmed = verdicts.where("toxic = 1").orderBy(*by_hash).limit(positives)
    others = verdicts.orderBy(*by_hash).limit(labelled)
    picked = confirmed.select("doc_id", F.lit(1).alias("kind")).union(others.select("doc_id", F.lit(0).alias("kind")))
    sample = sampled(docs, picked, doc_id, text)
    positive, other = ([f for k, f in sample if k == kind] for kind in (1, 0))
    if not positive:
        return _untaught(prior)
    vocabulary = telling([positive, other])
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _chosen_features(chosen.where("doc_id is not null").where(doc_fold() != 0), vocabulary)
    return fit_groups(positive, rows, vocabulary, prior, group)


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each whole text; null and empty texts get one too."""
    names = docs.columns
    at = names.index(text)

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, score])

    return in_small_batches(docs).mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Rows with null ids or texts, repeated rows and empty tables are scored
    like any others, and texts of any length whole; equal texts have equal
    scores. Other columns are not looked at.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, **options)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_scores(chosen, model).select(
        "doc_id",
        (doc_fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

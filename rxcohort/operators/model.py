"""Age- and sex-adjusted odds ratio."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rxcohort.operators.safety import dummy_encode, group_risks, risk_ratio_ci, study_cells
from rxcohort.plans.lookup import local_rows
from rxcohort.schema import ARMS, COMPARATOR_NAMES, OUTCOME_IDS, TARGET_NAMES, Cdm

COVARIATES = ("exposed", "age", "female")
MAX_ITERATIONS = 35
CLOSE = 1e-10  # of the coefficients, in the last step
SINGULAR = 1e-9  # least eigenvalue of the scaled normal equations

# Partitions of kept cells. A kept plan is not merged at run time, and a few
# hundred rows should not be read by one task per shuffle partition.
CELL_PARTITIONS = 16

# Fixed value: normal quantile of the 95 % Wald interval.
WALD_Z = 1.959963984540054

ODDS_SCHEMA = "or_adj double, lo double, hi double, converged boolean"
NO_ESTIMATE = (None, None, None, False)

# Covariate patterns fitted where the query is built; more stay spread out, and each step is an aggregation.
PATTERNS_PER_TASK = 20_000

Sums = tuple[float, np.ndarray, np.ndarray]


def _exp(x: float) -> float | None:
    try:
        return math.exp(x)
    except OverflowError:
        return None


def _local_sums(patterns: list[Row]) -> Callable[[np.ndarray], Sums]:
    """Log likelihood, gradient and normal equations at given coefficients, from patterns at hand."""
    x = np.array([[1.0, *(r[c] for c in COVARIATES)] for r in patterns], float)
    y, weight = (np.array([r[c] for r in patterns], float) for c in ("outcome", "weight"))

    def sums(beta: np.ndarray) -> Sums:
        eta = x @ beta
        p = np.exp(-np.logaddexp(0.0, -eta))
        likelihood = weight @ (y * eta - np.logaddexp(0.0, eta))
        return likelihood, x.T @ (weight * (y - p)), x.T @ (x * (weight * p * (1 - p))[:, None])

    return sums


def _spread_sums(patterns: DataFrame) -> Callable[[np.ndarray], Sums]:
    """The same, one aggregation over distributed patterns each time."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in COVARIATES)]
    size = len(x)
    y, weight = F.col("outcome").cast("double"), F.col("weight")

    def sums(beta: np.ndarray) -> Sums:
        eta = sum((F.lit(float(b)) * value for b, value in zip(beta, x)), F.lit(0.0))
        scored = patterns.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        own = y * F.col("eta") - F.greatest("eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta")))
        miss, spread = weight * (y - F.col("p")), weight * F.col("p") * (1 - F.col("p"))
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        found = scored.agg(
            F.sum(weight * own), *[F.sum(miss * v) for v in x], *[F.sum(spread * x[i] * x[j]) for i, j in pairs]
        ).first()
        normal = np.zeros((size, size))
        for (i, j), value in zip(pairs, found[1 + size :]):
            normal[i, j] = normal[j, i] = value
        return found[0], np.array(found[1 : 1 + size]), normal

    return sums


def _newton(sums: Callable[[np.ndarray], Sums]) -> tuple:
    """Newton steps to the maximum of the likelihood, halved where they overshoot.

    There is no estimate where covariates are collinear, or where the
    coefficients still move after the last step, as with separated outcomes.
    """
    beta = np.zeros(1 + len(COVARIATES))
    likelihood, gradient, normal = sums(beta)
    for _ in range(MAX_ITERATIONS):
        scale = 1 / np.sqrt(np.diag(normal))
        if not np.isfinite(scale).all():
            return NO_ESTIMATE
        scaled = normal * scale[:, None] * scale
        if np.linalg.eigvalsh(scaled)[0] < SINGULAR:
            return NO_ESTIMATE
        inverse = np.linalg.inv(scaled) * scale[:, None] * scale
        move = inverse @ gradient
        if np.abs(move).max() <= CLOSE * (1 + np.abs(beta).max()):
            se = math.sqrt(inverse[1, 1])
            return _exp(beta[1]), _exp(beta[1] - WALD_Z * se), _exp(beta[1] + WALD_Z * se), True
        for _ in range(MAX_ITERATIONS):
            found = sums(beta + move)
            if found[0] >= likelihood - CLOSE * (1 + abs(likelihood)):
                break
            move = move / 2
        beta, (likelihood, gradient, normal) = beta + move, found
    return NO_ESTIMATE


def _varied(patterns: DataFrame) -> bool:
    """Whether all covariates and the outcome take two values or more."""
    return all(patterns.agg(*[F.coalesce(F.max(c) > F.min(c), F.lit(False)) for c in (*COVARIATES, "outcome")]).first())


def _few(groups: DataFrame) -> list[Row] | None:
    """The rows of an aggregate, if they are few: its last stage is then a task or two, and reading it is one job."""
    rows = groups.limit(PATTERNS_PER_TASK + 1).collect()
    return rows if len(rows) <= PATTERNS_PER_TASK else None


def _fit(patterns: DataFrame) -> tuple:
    """Counted as small, the patterns are brought here and fitted without another job; else each step is one."""
    few = _few(patterns)
    if few is not None:
        differ = all(len({r[c] for r in few}) > 1 for c in (*COVARIATES, "outcome"))
        return _newton(_local_sums(few)) if differ else NO_ESTIMATE
    kept = patterns.coalesce(CELL_PARTITIONS).persist()
    try:
        return _newton(_spread_sums(kept)) if _varied(kept) else NO_ESTIMATE
    finally:
        kept.unpersist()


def _encoded(rows: DataFrame, arms: Sequence[str]) -> DataFrame:
    return dummy_encode(rows, arms).dropna(subset=[*COVARIATES, "outcome"])


def _weighted(rows: DataFrame, weight: str | None, arms: Sequence[str]) -> DataFrame:
    """Analysis rows reduced to one weighted row per distinct covariate pattern."""
    one = F.lit(1) if weight is None else F.col(weight)
    patterns = _encoded(rows, arms).groupBy(*COVARIATES, "outcome")
    return patterns.agg(F.sum(one).cast("double").alias("weight"))


def adjusted_odds_ratio(rows: DataFrame, arms: Sequence[str] = ARMS, weight: str | None = None) -> DataFrame:
    """Odds ratio of exposure from ``outcome ~ exposed + age + female``: or_adj, lo, hi, converged.

    ``rows`` are incident analysis rows, or cells counted in column ``weight``.
    They are reduced to covariate patterns, at most a few hundred weighted
    rows, which give the same estimates. Where no finite estimate exists the
    row holds NULLs and ``converged`` is false. The model is fitted when this
    is called.
    """
    return local_rows(rows.sparkSession, ODDS_SCHEMA, [_fit(_weighted(rows, weight, arms))])


def _few_cells(cells: DataFrame) -> DataFrame | None:
    """Cells as local rows in one partition, if they are few, so that what is derived from them needs no shuffle."""
    few = _few(cells)
    if few is None:
        return None
    schema = ", ".join(f"{name} {kind}" for name, kind in cells.dtypes)
    return local_rows(cells.sparkSession, schema, few)


def study_estimates(
    cells: DataFrame, arms: Sequence[str] = ARMS, weight: str = "persons"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arm risks, crude risk ratio and adjusted odds ratio from cells that are computed once.

    The results are a few local rows. Cells counted as few are brought here as
    well; otherwise they are kept until the estimates are made.
    """
    spark, few = cells.sparkSession, _few_cells(cells)
    held = cells.coalesce(CELL_PARTITIONS).persist() if few is None else few
    try:
        risks = group_risks(held if few is None else few.coalesce(1), arms, weight)
        risks = spark.createDataFrame(risks.toArrow(), risks.schema)
        if few is None:
            adjusted = adjusted_odds_ratio(held, arms, weight)
        else:  # a projection of local rows is no job; equal patterns may stay apart
            columns = [*COVARIATES, "outcome", F.col(weight).cast("double").alias("weight")]
            adjusted = local_rows(spark, ODDS_SCHEMA, [_fit(_encoded(few, arms).select(*columns))])
        return risks, risk_ratio_ci(risks.coalesce(1), arms), adjusted
    finally:
        held.unpersist()


def forest_rows(crude: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Estimates ready for a forest plot: measure, est, lo, hi."""
    first = crude.select(F.lit("Crude RR").alias("measure"), F.col("rr").alias("est"), "lo", "hi")
    second = adjusted.select(F.lit("Adjusted OR (age+sex)").alias("measure"), F.col("or_adj").alias("est"), "lo", "hi")
    return first.unionByName(second)


RECORD_SCHEMA = (
    "target_n bigint, target_events bigint, target_risk double, "
    "comparator_n bigint, comparator_events bigint, comparator_risk double, "
    "rr double, rr_lo double, rr_hi double, or_adj double, or_lo double, or_hi double, converged boolean"
)


def comparative_safety(
    cdm: Cdm,
    target: Iterable[str] = TARGET_NAMES,
    comparator: Iterable[str] = COMPARATOR_NAMES,
    ids: Sequence[int] = OUTCOME_IDS,
    arms: Sequence[str] = ARMS,
) -> DataFrame:
    """The whole active-comparator study as one record.

    The tables are read once: cohorts, outcomes and covariates are reduced to
    cells, and both risks and the model come from the kept cells.
    """
    risks, crude, adjusted = study_estimates(study_cells(cdm, target, comparator, ids, arms), arms)
    by_arm = {row["grp"]: row for row in risks.collect()}
    ratio = crude.first()
    record = tuple(by_arm[arm][c] for arm in arms for c in ("n", "events", "risk"))
    record += (ratio["rr"], ratio["lo"], ratio["hi"], *adjusted.first())
    return local_rows(cdm.person.sparkSession, RECORD_SCHEMA, [record])

"""Outcome risk: crude, and against an active comparator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxcohort.functions.summary import one_row, percent, share
from rxcohort.operators.codelists import codelist_by_ids
from rxcohort.operators.cohorts import HAS_PERSON, START, comparator_cohort, outcome_cohort
from rxcohort.operators.describe import age_at, with_sex
from rxcohort.plans.lookup import keep_codes, local_rows
from rxcohort.schema import ARMS, COMPARATOR_NAMES, OUTCOME_IDS, TARGET_NAMES, Cdm

# Fixed value: normal quantile used for the risk-ratio interval.
RISK_RATIO_Z = 1.96


def crude_safety(
    drug_exposure: DataFrame,
    person: DataFrame,
    condition_occurrence: DataFrame,
    codes: DataFrame,
    ids: Sequence[int] = OUTCOME_IDS,
    as_percent: bool = True,
) -> DataFrame:
    """Outcome after start in users, outcome ever in non-users.

    One row: exp_n, exp_ev, r_exp, unexp_n, unexp_ev, r_unexp, rr. A user
    counts if any event, also a recurrent one, is later than the start, that is
    if the last event is. Exposures and events are stacked and folded by person
    in one aggregation, so no set of persons is broadcast or joined.
    """
    exposures = keep_codes(drug_exposure.select("person_id", "drug_concept_id", START), "drug_concept_id", codes).select(
        "person_id", F.lit(True).alias("exposed"), F.col(START).cast("date").alias("start_date")
    )
    events = codelist_by_ids(condition_occurrence, "condition_concept_id", ids).select(
        "person_id", F.lit(False).alias("exposed"), F.col("condition_start_date").cast("date").alias("event_date")
    )
    folded = (
        exposures.unionByName(events, allowMissingColumns=True)
        .where(HAS_PERSON)
        .groupBy("person_id")
        .agg(
            F.bool_or("exposed").alias("exposed"),
            F.min("start_date").alias("index_date"),
            F.max("event_date").alias("last_event"),
        )
    )
    exposed = F.col("exposed")
    after = F.coalesce(F.col("last_event") > F.col("index_date"), F.lit(False))
    counts = one_row(
        folded.agg(
            F.count_if(exposed).alias("exp_n"),
            F.count_if(exposed & after).alias("exp_ev"),
            F.count_if(~exposed).alias("unexp_ev"),
        ),
        person.agg(F.count("*").alias("total")),
    ).withColumn("unexp_n", F.col("total") - F.col("exp_n"))
    r_exp, r_unexp = share(F.col("exp_ev"), F.col("exp_n")), share(F.col("unexp_ev"), F.col("unexp_n"))
    scale = F.lit(100.0 if as_percent else 1.0)
    return counts.select(
        "exp_n",
        "exp_ev",
        (scale * r_exp).alias("r_exp"),
        "unexp_n",
        "unexp_ev",
        (scale * r_unexp).alias("r_unexp"),
        F.coalesce(F.try_divide(r_exp, r_unexp), F.lit(float("nan"))).alias("rr"),
    )


def _analysis_persons(cohort: DataFrame, person: DataFrame, condition_occurrence: DataFrame, ids: Sequence[int]):
    """Cohort members with age, sex id and outcome flags, from the first-ever event.

    All three inputs have one row per person and meet on ``person_id``, which
    the cohort and the events are already grouped by.
    """
    born = person.select("person_id", "year_of_birth", "gender_concept_id")
    first_event = outcome_cohort(condition_occurrence, ids).select("person_id", F.col("index_date").alias("event"))
    joined = cohort.join(born, "person_id").join(first_event, "person_id", "left")

    def flag(test: Column) -> Column:
        return F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    return joined.select(
        "grp",
        age_at(F.col("index_date"), F.col("year_of_birth")).alias("age"),
        "gender_concept_id",
        flag(F.col("event") > F.col("index_date")).alias("outcome"),
        flag(F.col("event") <= F.col("index_date")).alias("prior_bleed"),
    )


def comparative_rows(
    cohort: DataFrame,
    person: DataFrame,
    condition_occurrence: DataFrame,
    concept: DataFrame,
    ids: Sequence[int] = OUTCOME_IDS,
) -> DataFrame:
    """One row per member with a known sex: grp, age, sex, outcome, prior_bleed."""
    rows = with_sex(_analysis_persons(cohort, person, condition_occurrence, ids), person, concept)
    return rows.select("grp", "age", F.upper("concept_name").alias("sex"), "outcome", "prior_bleed")


def comparative_cells(
    cohort: DataFrame,
    person: DataFrame,
    condition_occurrence: DataFrame,
    concept: DataFrame,
    ids: Sequence[int] = OUTCOME_IDS,
) -> DataFrame:
    """``comparative_rows`` counted per distinct row: grp, age, sex, outcome, prior_bleed, persons.

    Members are counted by sex id first and the few cells then get their sex
    name, so this is what risks and the model should be computed from.
    """
    keys = ["grp", "age", "outcome", "prior_bleed"]
    cells = (
        _analysis_persons(cohort, person, condition_occurrence, ids)
        .groupBy(*keys, "gender_concept_id")
        .agg(F.count("*").alias("persons"))
    )
    return (
        with_sex(cells, person, concept)
        .groupBy(*keys, F.upper("concept_name").alias("sex"))
        .agg(F.sum("persons").alias("persons"))
        .select("grp", "age", "sex", "outcome", "prior_bleed", "persons")
    )


def study_cells(
    cdm: Cdm,
    target: Iterable[str] = TARGET_NAMES,
    comparator: Iterable[str] = COMPARATOR_NAMES,
    ids: Sequence[int] = OUTCOME_IDS,
    arms: Sequence[str] = ARMS,
) -> DataFrame:
    """Counted analysis rows of an active-comparator study without prior cases."""
    cohort = comparator_cohort(cdm.drug_exposure, cdm.concept, target, comparator, arms)
    return incident_filter(comparative_cells(cohort, cdm.person, cdm.condition_occurrence, cdm.concept, ids))


def incident_filter(rows: DataFrame) -> DataFrame:
    """Drop members whose outcome began on or before their index date."""
    return rows.where(F.col("prior_bleed") == 0)


def dummy_encode(rows: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Add 0/1 columns exposed (target arm) and female; any other or unknown sex is 0."""

    def dummy(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    return rows.withColumn("exposed", dummy(F.col("grp") == arms[0])).withColumn(
        "female", dummy(F.col("sex") == "FEMALE")
    )


def group_risks(rows: DataFrame, arms: Sequence[str] = ARMS, weight: str | None = None) -> DataFrame:
    """Size, events and risk in percent of each arm: grp, n, events, risk.

    ``rows`` are analysis rows, or cells counted in column ``weight``. An arm
    without members is kept with zeros.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    counted = rows.groupBy("grp").agg(F.sum(one).alias("n"), F.sum(F.col("outcome") * one).alias("events"))
    listed = local_rows(rows.sparkSession, "grp string", [(arm,) for arm in arms])
    filled = listed.join(counted, "grp", "left").na.fill(0, ["n", "events"])
    return filled.select("grp", "n", "events", percent(F.col("events"), F.col("n")).alias("risk"))


def arm_counts(risks: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Both arms in one row: n1, a (target size, events), n0, c (comparator size, events)."""
    picks = []
    for arm, size, events in ((arms[0], "n1", "a"), (arms[1], "n0", "c")):
        here = F.col("grp") == arm
        picks += [
            F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(size),
            F.coalesce(F.max(F.when(here, F.col("events"))), F.lit(0)).alias(events),
        ]
    return risks.agg(*picks)


def risk_ratio_ci(risks: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """Risk ratio of the target arm with a log-normal 95 % interval: rr, lo, hi, stable.

    The ratio is NULL when the comparator arm has no risk to divide by, and the
    interval is NULL when either arm has no event.
    """

    def per(count: str) -> Column:
        return F.try_divide(F.lit(1.0), F.col(count).cast("double"))

    rr = F.try_divide(share(F.col("a"), F.col("n1")), share(F.col("c"), F.col("n0")))
    stable = (F.col("a") > 0) & (F.col("c") > 0)
    se = F.sqrt(per("a") - per("n1") + per("c") - per("n0"))

    def bound(sign: float) -> Column:
        return F.when(stable, F.exp(F.log(rr) + F.lit(sign * RISK_RATIO_Z) * se))

    return arm_counts(risks, arms).select(
        rr.alias("rr"), bound(-1.0).alias("lo"), bound(1.0).alias("hi"), stable.alias("stable")
    )


def risk_table(risks: DataFrame) -> DataFrame:
    """Arms ready for a bar chart: group, risk, events, n."""
    return risks.select(F.col("grp").alias("group"), "risk", "events", "n")

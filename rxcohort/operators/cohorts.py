"""Cohorts: one row per person with an index date.

Rows without a person id belong to nobody: they count as records, but make no
member of a cohort, no event of a person and no one's exposure.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.functions.summary import one_row, percent
from rxcohort.operators.codelists import codelist_by_ids, flagged
from rxcohort.plans.lookup import keep_codes, tag_codes
from rxcohort.schema import ARMS, COMPARATOR_NAMES, OUTCOME_IDS, TARGET_NAMES

HAS_PERSON = "person_id IS NOT NULL"
START = "drug_exposure_start_date"


def outcome_cohort(condition_occurrence: DataFrame, ids: Sequence[int] = OUTCOME_IDS) -> DataFrame:
    """First date of any of the given conditions per person: person_id, index_date."""
    events = codelist_by_ids(condition_occurrence, "condition_concept_id", ids)
    return events.where(HAS_PERSON).groupBy("person_id").agg(
        F.min(F.col("condition_start_date").cast("date")).alias("index_date")
    )


def new_user_cohort(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """First exposure to a code list per person: person_id, index_date."""
    exposed = keep_codes(drug_exposure.select("person_id", "drug_concept_id", START), "drug_concept_id", codes)
    return exposed.where(HAS_PERSON).groupBy("person_id").agg(F.min(F.col(START).cast("date")).alias("index_date"))


def cohort_members(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Persons ever exposed to a code list: person_id."""
    exposed = keep_codes(drug_exposure.select("person_id", "drug_concept_id"), "drug_concept_id", codes)
    return exposed.where(HAS_PERSON).select("person_id").distinct()


def cohort_share(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Cohort size against all persons: size, total, pct."""
    counts = one_row(cohort.agg(F.count("*").alias("size")), person.agg(F.count("*").alias("total")))
    return counts.withColumn("pct", percent(F.col("size"), F.col("total")))


def comparator_cohort(
    drug_exposure: DataFrame,
    concept: DataFrame,
    target: Iterable[str] = TARGET_NAMES,
    comparator: Iterable[str] = COMPARATOR_NAMES,
    arms: Sequence[str] = ARMS,
) -> DataFrame:
    """New users of the target, and comparator users who never took it: person_id, grp, index_date.

    Both arms come from one pass over the exposures and one aggregation by
    person, which also settles who never took the target.
    """
    lists = flagged(concept, {"in_target": target, "in_comparator": comparator})
    exposed = tag_codes(drug_exposure.select("person_id", "drug_concept_id", START), "drug_concept_id", lists)
    start = F.col(START).cast("date")
    per_person = exposed.where(HAS_PERSON).groupBy("person_id").agg(
        F.bool_or("in_target").alias("took_target"),
        F.min(F.when(F.col("in_target"), start)).alias("target_date"),
        F.min(F.when(F.col("in_comparator"), start)).alias("comparator_date"),
    )
    return per_person.select(
        "person_id",
        F.when(F.col("took_target"), F.lit(arms[0])).otherwise(F.lit(arms[1])).alias("grp"),
        F.when(F.col("took_target"), F.col("target_date")).otherwise(F.col("comparator_date")).alias("index_date"),
    )

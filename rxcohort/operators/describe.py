"""Rankings of conditions and drugs, and descriptions of a cohort."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxcohort.functions.summary import mean_of, mean_of_known, one_row, percent, quantile_of, value_counts
from rxcohort.operators.codelists import flagged, named
from rxcohort.operators.cohorts import START, new_user_cohort
from rxcohort.plans.lookup import add_names, keep_codes, local_rows, resolved, tag_codes
from rxcohort.schema import DRUG_PRESETS, OUTCOME_KEYWORDS


def _per_concept(facts: DataFrame, key: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Patients and records per concept id, then its name.

    Names are joined to one row per id, after the counting, so a drug or a
    condition that fills much of the table does not skew the join.
    """
    counted = facts.groupBy(F.col(key).alias("concept_id")).agg(
        F.count_distinct("person_id").alias("patients"), F.count("*").alias("records")
    )
    return counted.join(dictionary, "concept_id").select(
        F.col("concept_name").alias(name), "concept_id", "patients", "records"
    )


def _ranked(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("patients"), *[F.asc_nulls_last(t) for t in ties])


def top_conditions(condition_occurrence: DataFrame, concept: DataFrame, n: int = 15) -> DataFrame:
    """Conditions by patients: condition_name, concept_id, patients, records."""
    rows = _per_concept(condition_occurrence, "condition_concept_id", concept, "condition_name")
    return _ranked(rows, "concept_id").limit(n)


def top_drugs(drug_exposure: DataFrame, concept: DataFrame, n: int = 15) -> DataFrame:
    """Drugs by patients: drug_name, concept_id, patients."""
    rows = _per_concept(drug_exposure, "drug_concept_id", concept, "drug_name")
    return _ranked(rows.drop("records"), "concept_id").limit(n)


def keyword_conditions(
    condition_occurrence: DataFrame, concept: DataFrame, keywords: Iterable[str] = OUTCOME_KEYWORDS
) -> DataFrame:
    """Conditions whose name contains any keyword, by patients: condition_name, concept_id, patients."""
    found = resolved(named(concept, keywords))
    facts = keep_codes(condition_occurrence, "condition_concept_id", found)
    rows = _per_concept(facts, "condition_concept_id", found, "condition_name")
    return _ranked(rows.drop("records"), "concept_id")


def codelist_products(drug_exposure: DataFrame, concept: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Products inside a drug code list, by patients: concept_name, drug_concept_id, patients."""
    found = resolved(named(concept, keywords))
    facts = keep_codes(drug_exposure, "drug_concept_id", found)
    rows = _per_concept(facts, "drug_concept_id", found, "concept_name")
    return _ranked(rows, "concept_id").select(
        "concept_name", F.col("concept_id").alias("drug_concept_id"), "patients"
    )


def age_at(index_date: Column, year_of_birth: Column) -> Column:
    """Calendar-year age; months are not considered."""
    return (F.year(index_date) - year_of_birth).cast("bigint")


def cohort_ages(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Age at index of each cohort member found in ``person``: age."""
    born = person.select("person_id", "year_of_birth")
    return cohort.join(born, "person_id").select(age_at(F.col("index_date"), F.col("year_of_birth")).alias("age"))


def age_summary(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Mean and median age at index: mean_age, median_age."""
    return value_counts(cohort_ages(cohort, person), "age").agg(
        mean_of("age").alias("mean_age"), quantile_of("age", 0.5).alias("median_age")
    )


def with_sex(rows: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Rows with a known ``gender_concept_id``, and its concept_name."""
    used = person.select(F.col("gender_concept_id").alias("concept_id"))
    return add_names(rows, "gender_concept_id", used, concept)


def sex_breakdown(cohort: DataFrame, person: DataFrame, concept: DataFrame) -> DataFrame:
    """Cohort members per sex, with the percentage of the whole cohort: sex, patients, pct.

    Members are counted by sex id first; names meet those few rows only, so
    nothing needs to be known of the ids before the query runs.
    """
    sexes = person.select("person_id", "gender_concept_id")
    counted = (
        cohort.select("person_id")
        .join(sexes, "person_id", "left")
        .groupBy("gender_concept_id")
        .agg(F.count("*").alias("n"))
        .withColumn("size", F.sum("n").over(Window.partitionBy()))  # one row per sex id
    )
    names = concept.select(F.col("concept_id").alias("gender_concept_id"), "concept_name")
    by_sex = (
        counted.join(names, "gender_concept_id")
        .groupBy(F.col("concept_name").alias("sex"))
        .agg(F.sum("n").alias("patients"), F.max("size").alias("size"))
    )
    return _ranked(by_sex, "sex").select("sex", "patients", percent(F.col("patients"), F.col("size")).alias("pct"))


def age_distribution(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Age at index of each member, kept if 0 to 110: age."""
    return cohort_ages(cohort, person).where(F.col("age").between(0, 110))


def age_histogram(ages: DataFrame, width: int | None = 5, max_bins: int = 30) -> DataFrame:
    """Members per age bin: bin_start, patients.

    With ``width=None`` the bin is the narrowest of 1, 2, 5, 10, 20, 50 or 100
    years that spans the ages in at most ``max_bins`` bins.
    """
    counts = value_counts(ages, "age")
    if width is None:
        everyone = Window.partitionBy()  # one row per age
        span = F.max("age").over(everyone) - F.min("age").over(everyone)
        step = F.lit(100)
        for years in (50, 20, 10, 5, 2, 1):
            step = F.when(span <= F.lit(years * max_bins), F.lit(years)).otherwise(step)
    else:
        step = F.lit(width)
    start = (F.floor(F.col("age") / step) * step).cast("bigint")
    return counts.select(start.alias("bin_start"), "n").groupBy("bin_start").agg(F.sum("n").alias("patients")).orderBy("bin_start")


def cohort_metrics(
    drug_exposure: DataFrame, person: DataFrame, concept: DataFrame, keywords: Iterable[str]
) -> DataFrame:
    """Size, share and age of a drug's new users: size, total, pct, mean_age, median_age.

    The cohort is built once: members are counted by age, and those without a
    known age count for the size only.
    """
    cohort = new_user_cohort(drug_exposure, named(concept, keywords))
    cells = (
        cohort.join(person.select("person_id", "year_of_birth"), "person_id", "left")
        .groupBy(age_at(F.col("index_date"), F.col("year_of_birth")).alias("age"))
        .agg(F.count("*").alias("n"))
    )
    found = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), *_age_columns())
    counts = one_row(found, person.agg(F.count("*").alias("total")))
    return counts.select("size", "total", percent(F.col("size"), F.col("total")).alias("pct"), "mean_age", "median_age")


def _age_columns() -> list[Column]:
    return [mean_of_known("age").alias("mean_age"), quantile_of("age", 0.5).alias("median_age")]


def presets_summary(
    drug_exposure: DataFrame,
    person: DataFrame,
    concept: DataFrame,
    presets: Mapping[str, Iterable[str]] = DRUG_PRESETS,
) -> DataFrame:
    """``cohort_metrics`` of every preset: preset, size, total, pct, mean_age, median_age.

    The exposures are read once for all presets: each person gets one first
    date per preset, and persons are reduced to counts per preset and age.
    """
    labels = list(presets)
    flags = [f"preset_{i}" for i in range(len(labels))]
    codes = flagged(concept, dict(zip(flags, presets.values())))
    exposed = tag_codes(drug_exposure.select("person_id", "drug_concept_id", START), "drug_concept_id", codes)
    start = F.col(START).cast("date")
    per_person = exposed.groupBy("person_id").agg(
        *[
            F.when(F.bool_or(f), F.struct(F.lit(label).alias("preset"), F.min(F.when(F.col(f), start)).alias("date")))
            .alias(f)
            for f, label in zip(flags, labels)
        ]
    )
    born = person.select("person_id", "year_of_birth")
    cells = (
        per_person.join(born, "person_id", "left")
        .select("year_of_birth", F.explode(F.array_compact(F.array(*flags))).alias("entry"))
        .select(F.col("entry.preset").alias("preset"), age_at(F.col("entry.date"), F.col("year_of_birth")).alias("age"))
        .groupBy("preset", "age")
        .agg(F.count("*").alias("n"))
    )
    found = cells.groupBy("preset").agg(F.sum("n").alias("size"), *_age_columns())
    listed = local_rows(drug_exposure.sparkSession, "preset string", [(label,) for label in labels])
    total = person.agg(F.count("*")).scalar()
    return (
        listed.join(found, "preset", "left")
        .select("preset", F.coalesce("size", F.lit(0)).alias("size"), total.alias("total"), "mean_age", "median_age")
        .select(
            "preset", "size", "total", percent(F.col("size"), F.col("total")).alias("pct"), "mean_age", "median_age"
        )
    )

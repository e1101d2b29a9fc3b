"""How a drug is used: prescriptions, duration, co-medication and switching."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxcohort.functions.summary import mean_of, one_row, percent, quantile_of, six_numbers, value_counts
from rxcohort.functions.text import contains_any
from rxcohort.operators.codelists import flagged, labelled, named
from rxcohort.operators.cohorts import HAS_PERSON, START
from rxcohort.plans.lookup import broadcast_if_small, keep_codes, resolved, tag_codes
from rxcohort.schema import COMEDICATION_NAMES, TARGET_NAMES

END = "drug_exposure_end_date"


def drug_exposures(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Exposures to a code list, the end defaulting to the start: person_id, start_date, end_date."""
    rows = keep_codes(drug_exposure.select("person_id", "drug_concept_id", START, END), "drug_concept_id", codes)
    return rows.select(
        "person_id",
        F.col(START).cast("date").alias("start_date"),
        F.coalesce(F.col(END), F.col(START)).cast("date").alias("end_date"),
    )


def _rx_counts(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Persons per number of prescriptions: n_rx, n."""
    rows = keep_codes(drug_exposure.select("person_id", "drug_concept_id"), "drug_concept_id", codes)
    return value_counts(rows.where(HAS_PERSON).groupBy("person_id").agg(F.count("*").alias("n_rx")), "n_rx")


def rx_per_patient(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Prescriptions per exposed person: mean_rx, median_rx, max_rx."""
    return _rx_counts(drug_exposure, codes).agg(
        mean_of("n_rx").alias("mean_rx"), quantile_of("n_rx", 0.5).alias("median_rx"), F.max("n_rx").alias("max_rx")
    )


def treatment_span(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Days from a person's first start to last end: min, p25, median, p75, max, mean."""
    spans = (
        drug_exposures(drug_exposure, codes)
        .where(HAS_PERSON)
        .groupBy("person_id")
        .agg(F.datediff(F.max("end_date"), F.min("start_date")).cast("bigint").alias("span"))
    )
    return six_numbers(spans, "span", "span")


def days_supply_quality(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Prescriptions, and those with no usable days of supply: n_total, n_missing."""
    rows = keep_codes(drug_exposure.select("drug_concept_id", "days_supply"), "drug_concept_id", codes)
    missing = F.col("days_supply").isNull() | (F.col("days_supply") == 0)
    return rows.agg(F.count("*").alias("n_total"), F.count_if(missing).alias("n_missing"))


def _supplied_days(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Usable days of supply per prescription: days."""
    rows = keep_codes(drug_exposure.select("drug_concept_id", "days_supply"), "drug_concept_id", codes)
    return rows.where(F.col("days_supply") > 0).select(F.col("days_supply").cast("bigint").alias("days"))


def rx_days_supply_stats(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Days of supply per prescription: min, p25, median, p75, max, mean."""
    return six_numbers(_supplied_days(drug_exposure, codes), "days", "days")


def rx_span_stats(drug_exposure: DataFrame, codes: DataFrame) -> DataFrame:
    """Start-to-end days per prescription with a known end: min, p25, median, p75, max, mean."""
    rows = keep_codes(drug_exposure.select("drug_concept_id", START, END), "drug_concept_id", codes)
    days = F.datediff(F.col(END).cast("date"), F.col(START).cast("date")).cast("bigint")
    return six_numbers(rows.select(days.alias("days")), "days", "days")


def utilization(drug_exposure: DataFrame, concept: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """One record per drug: median_days_supply, mean_days_supply, mean_rx, median_rx."""
    codes = resolved(named(concept, keywords))
    days = value_counts(_supplied_days(drug_exposure, codes), "days").agg(
        quantile_of("days", 0.5).alias("median_days_supply"), mean_of("days").alias("mean_days_supply")
    )
    return one_row(days, rx_per_patient(drug_exposure, codes).drop("max_rx"))


def _marked(concept: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """The dictionary as what a person may have taken: drug_concept_id, taken (target, lead).

    Ids of one name share its smallest id as lead; drugs without a name share
    a NULL lead. Target ids are told apart by name. Leads are counted by name
    before anything moves, so a name with very many ids is one row of the join.
    """
    target = F.coalesce(contains_any(F.col("concept_name"), keywords), F.lit(False))
    others = concept.where(F.col("concept_name").isNotNull() & ~target)
    leads = others.groupBy("concept_name").agg(F.min("concept_id").alias("lead"))
    return concept.join(leads, "concept_name", "left").select(
        F.col("concept_id").alias("drug_concept_id"), F.struct(target.alias("target"), "lead").alias("taken")
    )


def _ever(taken: DataFrame) -> DataFrame:
    """What each user of the target took at any time, the target included: taken, one row per person and drug."""
    users = taken.groupBy("person_id").agg(F.bool_or("taken.target").alias("user"), F.collect_set("taken").alias("all"))
    return users.where("user").select(F.explode("all").alias("taken"))


def _within(taken: DataFrame, days: int) -> DataFrame:
    """As ``_ever``, of other drugs only those begun from the first day on the target to ``days`` later.

    A person's days on a drug are first reduced to the first and last one of
    each stretch of ``days + 1`` calendar days, and those on the target to the
    first. The days asked for are as many, so they either end a stretch or
    begin the next: a stretch has one of them if it ends on or after the first
    day on the target and begins no later than ``days`` after it. What is left
    of a person is bounded by drugs and calendar, not by prescriptions, and is
    never gathered in one value.
    """
    stretch = F.when(~F.col("taken.target"), F.floor(F.unix_date("day") / (days + 1)))
    spans = taken.groupBy("taken", stretch.alias("stretch"), "person_id").agg(
        F.min("day").alias("begin"), F.max("day").alias("last")
    )
    target = F.col("taken.target")
    first = F.min(F.when(target, F.col("begin"))).over(Window.partitionBy("person_id"))
    user = F.max(target.cast("int")).over(Window.partitionBy("person_id")) == 1
    timed = spans.select("person_id", "taken", "begin", "last", first.alias("first"), user.alias("user"))
    near = target | ((F.col("last") >= F.col("first")) & (F.col("begin") <= F.date_add("first", days)))
    return timed.where(F.col("user") & near).select("person_id", "taken").distinct().select("taken")


def _co_drugs(
    drug_exposure: DataFrame, concept: DataFrame, keywords: Iterable[str], n: int, days: int | None, unnamed: bool
) -> DataFrame:
    """Most used other drugs of a target's users: drug, patients, size (the number of users).

    The exposures are read once: each row becomes what it is to the question
    (the target, or another drug's lead id), and these are reduced to one per
    person and drug (or stretch of days) before the shuffle. The cohort size
    is counted from the same rows.
    """
    concept = concept.select("concept_id", "concept_name")
    marked = broadcast_if_small(_marked(concept, keywords))
    rows = drug_exposure.where(HAS_PERSON).select("person_id", "drug_concept_id", F.col(START).cast("date").alias("day"))
    taken = rows.join(marked, "drug_concept_id")
    counts = (_ever(taken) if days is None else _within(taken, days)).groupBy("taken").agg(F.count("*").alias("patients"))
    counts = counts.select("taken.target", "taken.lead", "patients")
    if not unnamed:
        counts = counts.where("target OR lead IS NOT NULL")
    leads = counts.join(concept.select(F.col("concept_id").alias("lead"), F.col("concept_name").alias("drug")), "lead", "left")
    # The target's own row counts all users, so it comes first and tells the size.
    top = leads.orderBy(F.desc("target"), F.desc("patients"), F.asc_nulls_last("drug")).limit(n + 1)
    size = F.max(F.when(F.col("target"), F.col("patients"))).over(Window.partitionBy())  # n + 1 rows
    found = top.withColumn("size", size).where("NOT target").select("drug", "patients", "size")
    return found.orderBy(F.desc("patients"), F.asc_nulls_last("drug"))


def concomitant_by_id(
    drug_exposure: DataFrame,
    concept: DataFrame,
    keywords: Iterable[str] = TARGET_NAMES,
    n: int = 10,
    days: int | None = None,
) -> DataFrame:
    """Drugs outside the code list taken by its users: drug, patients, pct of users.

    At any time, or with ``days`` only if begun from the first day on the code
    list to that many days later.
    """
    drugs = _co_drugs(drug_exposure, concept, keywords, n, days, unnamed=True)
    return drugs.select("drug", "patients", percent(F.col("patients"), F.col("size")).alias("pct"))


def concomitant_by_name(
    drug_exposure: DataFrame,
    concept: DataFrame,
    keywords: Iterable[str] = TARGET_NAMES,
    n: int = 10,
    days: int | None = None,
) -> DataFrame:
    """As ``concomitant_by_id``, excluding by name, so drugs without a name are left out: drug, patients."""
    return _co_drugs(drug_exposure, concept, keywords, n, days, unnamed=False).select("drug", "patients")


def comedication_coverage(
    drug_exposure: DataFrame,
    concept: DataFrame,
    keywords: Iterable[str] = TARGET_NAMES,
    comedication: Iterable[str] = COMEDICATION_NAMES,
) -> DataFrame:
    """Users of a drug who also took a drug class: n, size, pct."""
    codes = flagged(concept, {"in_target": keywords, "in_class": comedication})
    taken = tag_codes(drug_exposure.select("person_id", "drug_concept_id"), "drug_concept_id", codes)
    persons = taken.where(HAS_PERSON).groupBy("person_id").agg(
        F.bool_or("in_target").alias("user"), F.bool_or("in_class").alias("covered")
    )
    users = persons.where("user").agg(F.count_if("covered").alias("n"), F.count("*").alias("size"))
    return users.withColumn("pct", percent(F.col("n"), F.col("size")))


def ingredient_exposures(
    drug_exposure: DataFrame, concept: DataFrame, ingredients: Sequence[str] = TARGET_NAMES
) -> DataFrame:
    """Exposures tagged with the first ingredient their name contains: person_id, start_date, ingredient."""
    rows = drug_exposure.select("person_id", "drug_concept_id", F.col(START).cast("date").alias("start_date"))
    tagged = tag_codes(rows, "drug_concept_id", labelled(concept, ingredients))
    return tagged.select("person_id", "start_date", "ingredient")


def _start(start_date: str = "start_date", ingredient: str = "ingredient"):
    """Earliest dated start; two ingredients on one day resolve alphabetically."""
    return F.min(F.when(F.col(start_date).isNotNull(), F.struct(start_date, ingredient)))


def first_ingredient(exposures: DataFrame) -> DataFrame:
    """Starting ingredient and date per person: person_id, index_ingredient, index_date."""
    starts = exposures.where(HAS_PERSON).groupBy("person_id").agg(_start().alias("start"))
    return starts.select(
        "person_id", F.col("start.ingredient").alias("index_ingredient"), F.col("start.start_date").alias("index_date")
    )


def switching(exposures: DataFrame, days: int = 365) -> DataFrame:
    """Persons who start another ingredient within ``days`` after their first day: n, switched, pct.

    Of a person's days on an ingredient the first and last one of each stretch
    of ``days + 1`` calendar days are kept, which is merged before the shuffle
    and bounded by the calendar however often a drug is dispensed. That is
    enough: another ingredient begun after the first day shows by the first
    day of a stretch, and one begun on the first day, but second by alphabet,
    by a later day of the same stretch, which is at most ``days`` away, or by
    the first day of the next.
    """
    day = F.unix_date("start_date")
    spans = (
        exposures.where(HAS_PERSON)
        .groupBy("ingredient", F.floor(day / (days + 1)).alias("stretch"), "person_id")
        .agg(F.min(day).alias("begin"), F.max(day).alias("last"))
    )
    dated = F.when(F.col("begin").isNotNull(), F.struct("begin", "ingredient", "last"))
    persons = spans.groupBy("person_id").agg(F.collect_list(dated).alias("spans")).withColumn("first", F.array_min("spans"))

    def another(span: Column) -> Column:
        after = F.when(span["begin"] > F.col("first.begin"), span["begin"]).when(span["last"] > span["begin"], span["last"])
        return (span["ingredient"] != F.col("first.ingredient")) & (after <= F.col("first.begin") + days)

    moved = F.coalesce(F.exists("spans", another), F.lit(False))
    counts = persons.agg(F.count("*").alias("n"), F.count_if(moved).alias("switched"))
    return counts.withColumn("pct", percent(F.col("switched"), F.col("n")))


def starting_ingredient(exposures: DataFrame) -> DataFrame:
    """Persons per starting ingredient: ingredient, patients, pct."""
    counts = (
        first_ingredient(exposures)
        .groupBy(F.col("index_ingredient").alias("ingredient"))
        .agg(F.count("*").alias("patients"))
    )
    size = F.sum("patients").over(Window.partitionBy())  # one row per ingredient
    return counts.select("ingredient", "patients", percent(F.col("patients"), size).alias("pct")).orderBy(
        F.desc("patients"), F.asc_nulls_last("ingredient")
    )

from datetime import date

import pytest
from tables import (
    ACET, BLEED, CONCEPTS, FEMALE, IBU, MALE, NAP, UNKNOWN_SEX, UNMAPPED, cdm, day, dx, people, rx, values,
)

from rxcohort.operators import describe
from rxcohort.schema import TARGET_NAMES


def cohort_of(spark, *members):
    return spark.createDataFrame(list(members), "person_id bigint, index_date date")


def test_top_conditions_drops_unmapped_and_breaks_ties_by_id(spark):
    conditions = [dx(1, BLEED, 0), dx(1, BLEED, 1), dx(2, 4027663, 0), dx(3, 40, 0), dx(4, 40, 0)]
    conditions += [dx(p, 999, 0) for p in range(9)]
    t = cdm(spark, conditions=conditions)
    got = [tuple(r) for r in describe.top_conditions(t.condition_occurrence, t.concept, 2).collect()]
    assert got == [("Sinusitis", 40, 2, 2), ("Gastrointestinal hemorrhage", BLEED, 1, 2)]


def test_top_drugs(spark):
    t = cdm(spark, drugs=[rx(1, IBU, 0), rx(1, IBU, 1), rx(1, NAP, 0), rx(2, NAP, 0), rx(3, UNMAPPED, 0)])
    got = [tuple(r) for r in describe.top_drugs(t.drug_exposure, t.concept).collect()]
    assert got == [("NAPROXEN 500", NAP, 2), ("Ibuprofen 100mg", IBU, 1)]


def test_keyword_conditions_and_products(spark):
    t = cdm(
        spark,
        drugs=[rx(1, IBU, 0), rx(2, IBU, 1), rx(1, NAP, 0), rx(1, ACET, 0)],
        conditions=[dx(1, BLEED, 0), dx(2, 4027663, 0), dx(3, 4027663, 0), dx(3, 40, 0)],
    )
    got = [tuple(r) for r in describe.keyword_conditions(t.condition_occurrence, t.concept).collect()]
    assert got == [("Peptic ulcer", 4027663, 2), ("Gastrointestinal hemorrhage", BLEED, 1)]
    got = [tuple(r) for r in describe.codelist_products(t.drug_exposure, t.concept, TARGET_NAMES).collect()]
    assert got == [("Ibuprofen 100mg", IBU, 2), ("NAPROXEN 500", NAP, 1)]


def test_age_range_applies_to_the_distribution_only(spark):
    index = date(2000, 6, 1)
    cohort = cohort_of(spark, *[(i, index) for i in range(1, 6)])
    person = spark.createDataFrame(
        [(1, 2001, 1), (2, 2000, 1), (3, 1890, 1), (4, 1889, 1), (6, 1950, 1)],
        "person_id bigint, year_of_birth bigint, gender_concept_id bigint",
    )
    assert values(describe.age_distribution(cohort, person)) == [(0,), (110,)]
    assert values(describe.age_summary(cohort, person)) == [((-1 + 0 + 110 + 111) / 4, 55.0)]


def test_age_of_empty_cohort(spark):
    t = cdm(spark, people(1))
    assert values(describe.age_summary(cohort_of(spark), t.person)) == [(None, None)]
    assert values(describe.age_histogram(describe.age_distribution(cohort_of(spark), t.person), None)) == []


def test_sex_breakdown_counts_against_whole_cohort(spark):
    t = cdm(spark, people(1, 2) + people(3, sex=MALE) + people(4, sex=UNKNOWN_SEX) + people(5, sex=None))
    cohort = cohort_of(spark, *[(i, day(0)) for i in (1, 2, 3, 4, 5, 6, 7, 8)])
    got = [tuple(r) for r in describe.sex_breakdown(cohort, t.person, t.concept).collect()]
    assert got == [("Female", 2, 25.0), ("Male", 1, 12.5)]


def test_sexes_of_one_name_are_one_row(spark):
    t = cdm(spark, people(1) + people(2, sex=9), concept=CONCEPTS + [(9, "Female")])
    cohort = cohort_of(spark, (1, day(0)), (2, day(0)))
    assert values(describe.sex_breakdown(cohort, t.person, t.concept)) == [("Female", 2, 100.0)]


@pytest.mark.parametrize(
    "ages, width, max_bins, expected",
    [
        ([0, 4, 5, 9, 10], 5, 30, [(0, 2), (5, 2), (10, 1)]),
        ([7, 27], None, 30, [(7, 1), (27, 1)]),
        ([7, 47], None, 30, [(6, 1), (46, 1)]),
        ([7, 97], None, 30, [(5, 1), (95, 1)]),
        ([7, 97], None, 4, [(0, 1), (50, 1)]),
    ],
)
def test_age_histogram(spark, ages, width, max_bins, expected):
    df = spark.createDataFrame([(a,) for a in ages], "age bigint")
    got = [tuple(r) for r in describe.age_histogram(df, width, max_bins).collect()]
    assert got == expected


def test_metrics_and_presets_agree(spark):
    drugs = [rx(1, IBU, 400), rx(1, NAP, 5), rx(2, NAP, 5), rx(3, ACET, 5), rx(9, IBU, 1), rx(4, IBU, None)]
    t = cdm(spark, people(1, 2) + people(3, 4, born=1990), drugs)
    presets = {"either": ["ibuprofen", "naproxen"], "one": ["ibuprofen"], "none": ["celecoxib"]}
    got = {r[0]: tuple(r)[1:] for r in describe.presets_summary(t.drug_exposure, t.person, t.concept, presets).collect()}
    for label, names in presets.items():
        alone = describe.cohort_metrics(t.drug_exposure, t.person, t.concept, names)
        assert got[label] == tuple(alone.first())
    assert got["either"] == (4, 4, 100.0, 40.0, 40.0)
    assert got["none"] == (0, 4, 0.0, None, None)

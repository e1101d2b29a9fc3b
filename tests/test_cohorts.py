import pytest
from tables import ACET, ASPIRIN, BLEED, BOTH, CONCEPTS, IBU, NAMELESS, NAP, UNMAPPED, cdm, day, dx, people, rx, values

from rxcohort.operators import codelists, cohorts
from rxcohort.schema import TARGET_NAMES


def codes(t, names=TARGET_NAMES):
    return codelists.named(t.concept, names)


def test_names_match_any_case_and_literally(spark):
    t = cdm(spark, concept=[(1, "IBUPROFEN"), (2, "ibu%en"), (3, "o'naproxen"), (4, None), (5, "x_y"), (6, "xzy")])
    assert [r[0] for r in values(codelists.named(t.concept, ["iBuProfen"]))] == [1]
    assert [r[0] for r in values(codelists.named(t.concept, ["ibu%en"]))] == [2]
    assert [r[0] for r in values(codelists.named(t.concept, ["o'nap"]))] == [3]
    assert [r[0] for r in values(codelists.named(t.concept, ["x_y"]))] == [5]
    assert values(codelists.named(t.concept, [])) == []
    assert sorted(r[0] for r in values(codelists.not_named(t.concept, ["x"]))) == [1, 2]


def test_codelist_holds_used_ids_only(spark):
    t = cdm(spark, drugs=[rx(1, IBU, 0), rx(2, IBU, 0), rx(1, ACET, 0), rx(1, UNMAPPED, 0), rx(1, None, 0)])
    assert values(codelists.codelist_by_name(t.drug_exposure, t.concept, TARGET_NAMES)) == [(IBU,)]


def test_first_match_wins(spark):
    t = cdm(spark)
    labels = dict(values(codelists.labelled(t.concept, TARGET_NAMES)))
    assert labels == {IBU: "ibuprofen", NAP: "naproxen", BOTH: "ibuprofen"}


def test_outcome_cohort_takes_first_date(spark):
    t = cdm(spark, conditions=[dx(1, BLEED, 9), dx(1, 4027663, 4), dx(1, 40, 1), dx(2, 40, 1), dx(3, BLEED, None)])
    assert values(cohorts.outcome_cohort(t.condition_occurrence)) == [(1, day(4)), (3, None)]


def test_new_users_and_members(spark):
    drugs = [rx(1, IBU, 5), rx(1, NAP, 3), rx(2, ACET, 1), rx(3, BOTH, None), rx(4, UNMAPPED, 1), rx(5, NAMELESS, 1)]
    t = cdm(spark, drugs=drugs)
    assert values(cohorts.new_user_cohort(t.drug_exposure, codes(t))) == [(1, day(3)), (3, None)]
    assert values(cohorts.cohort_members(t.drug_exposure, codes(t))) == [(1,), (3,)]


def test_dates_given_as_text(spark):
    t = cdm(spark, drugs=[rx(1, IBU, 5), rx(1, IBU, 4)])
    text = t.drug_exposure.withColumn("drug_exposure_start_date", t.drug_exposure.drug_exposure_start_date.cast("string"))
    assert values(cohorts.new_user_cohort(text, codes(t))) == [(1, day(4))]


@pytest.mark.parametrize("n_people, expected", [(4, (2, 4, 50.0)), (0, (2, 0, 0.0))])
def test_cohort_share(spark, n_people, expected):
    t = cdm(spark, people(*range(n_people)), [rx(1, IBU, 5), rx(2, IBU, 5), rx(2, IBU, 6)])
    assert values(cohorts.cohort_share(cohorts.new_user_cohort(t.drug_exposure, codes(t)), t.person)) == [expected]


def test_share_of_empty_cohort(spark):
    t = cdm(spark, people(1, 2))
    assert values(cohorts.cohort_share(cohorts.new_user_cohort(t.drug_exposure, codes(t)), t.person)) == [(0, 2, 0.0)]


def test_comparator_never_took_target(spark):
    drugs = [
        rx(1, IBU, 9), rx(1, ACET, 1),           # both drugs: target arm, from the target date
        rx(2, ACET, 7), rx(2, ACET, 3),          # comparator only
        rx(3, ACET, 2), rx(3, NAP, None),        # took the target on an unknown day
        rx(4, ASPIRIN, 1),
    ]
    t = cdm(spark, drugs=drugs)
    got = values(cohorts.comparator_cohort(t.drug_exposure, t.concept))
    assert got == [(1, "NSAID", day(9)), (2, "Acetaminophen", day(3)), (3, "NSAID", None)]


def test_product_of_both_arms_counts_as_target(spark):
    t = cdm(spark, drugs=[rx(1, 50, 2)], concept=CONCEPTS + [(50, "Acetaminophen / Ibuprofen")])
    assert values(cohorts.comparator_cohort(t.drug_exposure, t.concept)) == [(1, "NSAID", day(2))]

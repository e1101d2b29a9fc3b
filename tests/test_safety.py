import math

import numpy as np
import pytest
from tables import ACET, BLEED, FEMALE, IBU, MALE, UNKNOWN_SEX, UNMAPPED, cdm, dx, people, rx, values

from rxcohort.operators import codelists, cohorts, model, safety
from rxcohort.schema import TARGET_NAMES

ROW = "grp string, age bigint, sex string, outcome bigint, prior_bleed bigint"


def crude(t, **options):
    codes = codelists.named(t.concept, TARGET_NAMES)
    return safety.crude_safety(t.drug_exposure, t.person, t.condition_occurrence, codes, **options).first()


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_crude_counts_recurrent_and_not_same_day_events(spark):
    t = cdm(
        spark,
        people(*range(1, 9)),
        [rx(1, IBU, 10), rx(2, IBU, 10), rx(3, IBU, 10), rx(4, IBU, 10), rx(5, ACET, 10)],
        [dx(1, BLEED, 3), dx(1, BLEED, 12), dx(2, BLEED, 10), dx(3, BLEED, None), dx(5, BLEED, 1), dx(6, BLEED, None)],
    )
    assert tuple(crude(t)) == (4, 1, 25.0, 4, 2, 50.0, 0.5)
    assert tuple(crude(t, as_percent=False)) == (4, 1, 0.25, 4, 2, 0.5, 0.5)


def test_crude_without_exposed_or_events(spark):
    none = crude(cdm(spark, people(1, 2), [rx(1, ACET, 1)], [dx(1, BLEED, 5)]))
    assert tuple(none) == (0, 0, 0.0, 2, 1, 50.0, 0.0)
    no_events = crude(cdm(spark, people(1, 2), [rx(1, IBU, 1)], [dx(1, BLEED, 5)]))
    assert tuple(no_events)[:6] == (1, 1, 100.0, 1, 0, 0.0) and math.isnan(no_events["rr"])
    empty = crude(cdm(spark))
    assert tuple(empty)[:6] == (0, 0, 0.0, 0, 0, 0.0) and math.isnan(empty["rr"])


def study(spark):
    return cdm(
        spark,
        people(1, 2, 3, 4) + people(5, sex=MALE) + people(6, sex=UNKNOWN_SEX),
        [rx(p, IBU, 10) for p in (1, 2, 3, 6)] + [rx(4, ACET, 400), rx(5, ACET, 10), rx(7, ACET, 1)],
        [dx(1, BLEED, 10), dx(2, BLEED, 11), dx(3, BLEED, 1), dx(3, BLEED, 50), dx(5, 4027663, 90), dx(4, 40, 900)],
    )


def test_first_event_decides_in_comparative_rows(spark):
    t = study(spark)
    cohort = cohorts.comparator_cohort(t.drug_exposure, t.concept)
    rows = safety.comparative_rows(cohort, t.person, t.condition_occurrence, t.concept)
    expected = [
        ("Acetaminophen", 40, "MALE", 1, 0),
        ("Acetaminophen", 41, "FEMALE", 0, 0),
        ("NSAID", 40, "FEMALE", 0, 1),
        ("NSAID", 40, "FEMALE", 0, 1),
        ("NSAID", 40, "FEMALE", 1, 0),
    ]
    assert values(rows) == expected
    cells = safety.comparative_cells(cohort, t.person, t.condition_occurrence, t.concept)
    assert sorted(r[:5] for r in values(cells) for _ in range(r[5])) == expected
    assert values(safety.incident_filter(rows)) == [expected[0], expected[1], expected[4]]


def test_rows_and_cells_give_the_same_risks(spark):
    t = study(spark)
    cohort = cohorts.comparator_cohort(t.drug_exposure, t.concept)
    rows = safety.incident_filter(safety.comparative_rows(cohort, t.person, t.condition_occurrence, t.concept))
    from_cells = safety.group_risks(safety.study_cells(t), weight="persons")
    assert values(safety.group_risks(rows)) == values(from_cells) == [
        ("Acetaminophen", 2, 1, 50.0), ("NSAID", 1, 1, 100.0),
    ]
    assert values(safety.risk_table(from_cells)) == [("Acetaminophen", 50.0, 1, 2), ("NSAID", 100.0, 1, 1)]


def test_published_risk_ratio(spark):
    """Arm counts and the ratio with its interval as published for the original data."""
    risks = spark.createDataFrame(
        [("NSAID", 1486, 285, 19.2), ("Acetaminophen", 779, 303, 38.9)], "grp string, n bigint, events bigint, risk double"
    )
    got = safety.risk_ratio_ci(risks).first()
    assert [round(got[c], 4) for c in ("rr", "lo", "hi")] == [0.4931, 0.4302, 0.5652] and got["stable"]


@pytest.mark.parametrize(
    "target, comparator, expected",
    [
        ((10, 0), (10, 5), (0.0, None, None, False)),
        ((10, 5), (10, 0), (None, None, None, False)),
        ((0, 0), (10, 5), (0.0, None, None, False)),
        ((10, 10), (10, 10), (1.0, 1.0, 1.0, True)),
    ],
)
def test_unstable_risk_ratio(spark, target, comparator, expected):
    rows = []
    for arm, (n, events) in (("NSAID", target), ("Acetaminophen", comparator)):
        rows += [(arm, 40, "MALE", int(i < events), 0) for i in range(n)]
    risks = safety.group_risks(rows_of(spark, rows))
    assert {r["grp"]: (r["n"], r["events"]) for r in risks.collect()} == {"NSAID": target, "Acetaminophen": comparator}
    assert tuple(safety.risk_ratio_ci(risks).first()) == expected


def test_dummies(spark):
    rows = [("NSAID", 1, "FEMALE", 0, 0), ("Acetaminophen", 1, "Female", 0, 0), ("NSAID", 1, None, 0, 0)]
    got = {(r["grp"], r["sex"]): (r["exposed"], r["female"]) for r in safety.dummy_encode(rows_of(spark, rows)).collect()}
    assert got == {("NSAID", "FEMALE"): (1.0, 1.0), ("Acetaminophen", "Female"): (0.0, 0.0), ("NSAID", None): (1.0, 0.0)}


def newton(rows):
    """Plain maximum-likelihood logit with Wald interval for the first covariate after the intercept."""
    x = np.array([[1.0, g == "NSAID", age, sex == "FEMALE"] for g, age, sex, *_ in rows], dtype=float)
    y = np.array([r[3] for r in rows], dtype=float)
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = x.T @ (x * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p))
    se = math.sqrt(np.linalg.inv(hessian)[1, 1])
    return [math.exp(beta[1] + k * 1.959963984540054 * se) for k in (0, -1, 1)]


def random_rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        arm, sex, age = rng.choice(["NSAID", "Acetaminophen"]), rng.choice(["FEMALE", "MALE", "OTHER"]), int(rng.integers(20, 80))
        risk = 1 / (1 + math.exp(2 - 0.02 * age - 0.5 * (arm == "NSAID")))
        rows.append((str(arm), age, str(sex), int(rng.random() < risk), 0))
    return rows


def test_adjusted_odds_ratio_matches_newton(spark):
    rows = random_rows()
    frame = rows_of(spark, rows + [("NSAID", None, "MALE", 1, 0)])
    got = model.adjusted_odds_ratio(frame).first()
    assert got["converged"]
    assert np.allclose([got["or_adj"], got["lo"], got["hi"]], newton(rows), rtol=1e-7)
    cells = frame.groupBy("grp", "age", "sex", "outcome").count()
    weighted = model.adjusted_odds_ratio(cells, weight="count").first()
    assert np.allclose([weighted["or_adj"], weighted["lo"], weighted["hi"]], newton(rows), rtol=1e-7)


def test_many_patterns_stay_spread_out(spark, monkeypatch):
    monkeypatch.setattr(model, "PATTERNS_PER_TASK", 0)
    rows = random_rows()
    got = model.adjusted_odds_ratio(rows_of(spark, rows)).first()
    assert np.allclose([got["or_adj"], got["lo"], got["hi"]], newton(rows), rtol=1e-7)


@pytest.mark.parametrize(
    "change",
    [
        lambda r: (r[0], r[1], "MALE", r[3], 0),               # constant sex
        lambda r: (r[0], r[1], r[2], 0, 0),                     # no events
        lambda r: ("NSAID", r[1], r[2], r[3], 0),               # one arm
        lambda r: (r[0], r[1], r[2], int(r[0] == "NSAID"), 0),  # outcome decided by the arm
        lambda r: (r[0], None, r[2], r[3], 0),                  # no age known
        lambda r: (r[0], 30 + 10 * (r[0] == "NSAID"), r[2], r[3], 0),  # age tells the arm
        lambda r: (r[0], r[1], "FEMALE" if r[0] == "NSAID" else "MALE", r[3], 0),  # so does sex
        lambda r: (r[0], r[1], r[2], int(r[0] == "NSAID" and r[3]), 0),  # events in one arm only
    ],
)
def test_no_finite_estimate(spark, change):
    got = model.adjusted_odds_ratio(rows_of(spark, [change(r) for r in random_rows(200)])).first()
    assert tuple(got) == (None, None, None, False)


def test_forest_and_record(spark):
    rows = random_rows(300)
    people_, drugs, conditions = [], [], []
    for i, (arm, age, sex, outcome, _) in enumerate(rows):
        people_.append((i, 2000 - age, FEMALE if sex == "FEMALE" else MALE))
        drugs.append(rx(i, IBU if arm == "NSAID" else ACET, 10))
        if outcome:
            conditions.append(dx(i, BLEED, 20))
    t = cdm(spark, people_, drugs + [rx(1, UNMAPPED, 0)], conditions)
    record = model.comparative_safety(t).first()
    assert np.allclose([record["or_adj"], record["or_lo"], record["or_hi"]], newton(rows), rtol=1e-7)
    a = sum(r[3] for r in rows if r[0] == "NSAID")
    n1 = sum(r[0] == "NSAID" for r in rows)
    assert (record["target_n"], record["target_events"], record["target_risk"]) == (n1, a, 100 * a / n1)
    _, crude_ratio, adjusted = model.study_estimates(safety.study_cells(t))
    forest = [tuple(r) for r in model.forest_rows(crude_ratio, adjusted).collect()]
    assert forest[0] == ("Crude RR", record["rr"], record["rr_lo"], record["rr_hi"])
    assert forest[1][0] == "Adjusted OR (age+sex)"


def test_empty_study(spark):
    record = model.comparative_safety(cdm(spark)).first()
    assert tuple(record) == (0, 0, 0.0, 0, 0, 0.0, None, None, None, None, None, None, False)


def test_rows_without_a_person_are_nobody(spark):
    t = cdm(
        spark,
        people(1, 2, 3),
        [rx(1, IBU, 1), rx(None, IBU, 1), rx(None, ACET, 1)],
        [dx(2, BLEED, 5), dx(None, BLEED, 5), dx(None, BLEED, 6)],
    )
    assert tuple(crude(t))[:6] == (1, 0, 0.0, 2, 1, 50.0)
    assert values(cohorts.outcome_cohort(t.condition_occurrence).select("person_id")) == [(2,)]
    assert values(cohorts.new_user_cohort(t.drug_exposure, codelists.named(t.concept, TARGET_NAMES)).select("person_id")) == [(1,)]
    assert values(cohorts.comparator_cohort(t.drug_exposure, t.concept).select("person_id")) == [(1,)]

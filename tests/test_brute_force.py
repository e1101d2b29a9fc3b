"""Operators against plain loops over random tables with gaps, ties and repeats."""

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from tables import ACET, ASPIRIN, BLEED, BOTH, CONCEPTS, FEMALE, IBU, MALE, NAMELESS, NAP, OMEP, UNMAPPED, cdm, day, values

from rxcohort.operators import codelists, cohorts, describe, safety
from rxcohort.operators import utilization as use
from rxcohort.schema import TARGET_NAMES

NAMES = dict(CONCEPTS)


class Tables:
    def __init__(self, spark, seed):
        rnd = random.Random(seed)
        maybe = lambda x, p=0.1: None if rnd.random() < p else x
        drugs = [IBU, NAP, BOTH, ACET, ACET, OMEP, ASPIRIN, NAMELESS, UNMAPPED, None]
        self.person = [
            (i, maybe(rnd.randint(1885, 2003)), maybe(rnd.choice([FEMALE, MALE, 77]))) for i in range(40)
        ]
        self.rx, self.dx = [], []
        for _ in range(160):
            start = maybe(rnd.choice([0, 1, 365, 366, rnd.randint(0, 800)]), 0.05)
            end = None if start is None else maybe(start + rnd.randint(0, 30), 0.3)
            row = (rnd.randint(0, 47), rnd.choice(drugs), start, end, maybe(rnd.choice([0, 5, 7, 30]), 0.2))
            self.rx += [row] * rnd.choice([1, 1, 1, 3])
        for _ in range(60):
            row = (rnd.randint(0, 47), rnd.choice([BLEED, 4027663, 40, 555, None]), maybe(rnd.randint(0, 800)))
            self.dx += [row] * rnd.choice([1, 1, 2])
        date = lambda n: None if n is None else day(n)
        self.t = cdm(
            spark,
            self.person,
            [(p, d, date(s), date(e), x) for p, d, s, e, x in self.rx],
            [(p, c, date(s)) for p, c, s in self.dx],
        )


@pytest.fixture(scope="module", params=[1, 2, 3])
def tables(spark, request):
    return Tables(spark, request.param)


def matches(code, words):
    name = NAMES.get(code)
    return name is not None and any(w in name.lower() for w in words)


def first(pairs):
    """Smallest known value per key, None where no value is known."""
    out = {}
    for key, value in pairs:
        known = out.get(key)
        out[key] = known if value is None else value if known is None else min(known, value)
    return out


def six(xs):
    if not xs:
        return [None] * 6
    return [min(xs), *np.percentile(xs, [25, 50, 75]), max(xs), np.mean(xs)]


def same(row, expected):
    assert len(row) == len(expected)
    for a, b in zip(row, expected):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-12)), (tuple(row), expected)


def target_rows(x):
    return [r for r in x.rx if matches(r[1], TARGET_NAMES)]


def codes(x):
    return codelists.named(x.t.concept, TARGET_NAMES)


def dated(index):
    return sorted(((p, None if d is None else day(d)) for p, d in index.items()), key=repr)


def age(index, year):
    return None if index is None or year is None else day(index).year - year


def test_cohorts(tables):
    x = tables
    index = first((p, s) for p, _, s, _, _ in target_rows(x))
    assert values(cohorts.new_user_cohort(x.t.drug_exposure, codes(x))) == dated(index)
    assert values(cohorts.cohort_members(x.t.drug_exposure, codes(x))) == sorted(((p,) for p in index), key=repr)
    events = first((p, s) for p, c, s in x.dx if c in (BLEED, 4027663))
    assert values(cohorts.outcome_cohort(x.t.condition_occurrence)) == dated(events)
    other = first((p, s) for p, d, s, _, _ in x.rx if matches(d, ["acetaminophen"]))
    arms = [(p, "NSAID", d) for p, d in dated(index)]
    arms += [(p, "Acetaminophen", d) for p, d in dated({p: s for p, s in other.items() if p not in index})]
    assert values(cohorts.comparator_cohort(x.t.drug_exposure, x.t.concept)) == sorted(arms, key=repr)


def test_rankings(tables):
    x = tables
    for facts, rank, has_records in (
        ([(p, c) for p, c, _ in x.dx], describe.top_conditions(x.t.condition_occurrence, x.t.concept, 3), True),
        ([(r[0], r[1]) for r in x.rx], describe.top_drugs(x.t.drug_exposure, x.t.concept, 3), False),
    ):
        patients, records = defaultdict(set), Counter()
        for p, c in facts:
            if c in NAMES:
                patients[c].add(p)
                records[c] += 1
        order = sorted(patients, key=lambda c: (-len(patients[c]), c))[:3]
        expected = [(NAMES[c], c, len(patients[c])) + ((records[c],) if has_records else ()) for c in order]
        assert [tuple(r) for r in rank.collect()] == expected


def test_description(tables):
    x = tables
    index = first((p, s) for p, _, s, _, _ in target_rows(x))
    people = {p: (year, sex) for p, year, sex in x.person}
    ages = [a for p, d in index.items() if p in people and (a := age(d, people[p][0])) is not None]
    cohort = cohorts.new_user_cohort(x.t.drug_exposure, codes(x))
    same(describe.age_summary(cohort, x.t.person).first(), (statistics.mean(ages), statistics.median(ages)))
    assert values(describe.age_distribution(cohort, x.t.person)) == sorted(((a,) for a in ages if 0 <= a <= 110), key=repr)
    sexes = Counter(NAMES[people[p][1]] for p in index if p in people and people[p][1] in NAMES)
    got = {r["sex"]: (r["patients"], r["pct"]) for r in describe.sex_breakdown(cohort, x.t.person, x.t.concept).collect()}
    assert got == {s: (n, 100 * n / len(index)) for s, n in sexes.items()}
    metrics = describe.cohort_metrics(x.t.drug_exposure, x.t.person, x.t.concept, TARGET_NAMES).first()
    same(metrics, (len(index), 40, 100 * len(index) / 40, statistics.mean(ages), statistics.median(ages)))


def test_utilization(tables):
    x = tables
    rows = target_rows(x)
    per_person = Counter(r[0] for r in rows)
    n_rx = list(per_person.values())
    same(use.rx_per_patient(x.t.drug_exposure, codes(x)).first(), (np.mean(n_rx), np.median(n_rx), max(n_rx)))
    spans = []
    for p in per_person:
        starts = [s for q, _, s, _, _ in rows if q == p and s is not None]
        ends = [e if e is not None else s for q, _, s, e, _ in rows if q == p and (e is not None or s is not None)]
        if starts:
            spans.append(max(ends) - min(starts))
    same(use.treatment_span(x.t.drug_exposure, codes(x)).first(), six(spans))
    supply = [r[4] for r in rows]
    assert values(use.days_supply_quality(x.t.drug_exposure, codes(x))) == [(len(rows), sum(not d for d in supply))]
    same(use.rx_days_supply_stats(x.t.drug_exposure, codes(x)).first(), six([d for d in supply if d]))
    lengths = [e - s for _, _, s, e, _ in rows if s is not None and e is not None]
    same(use.rx_span_stats(x.t.drug_exposure, codes(x)).first(), six(lengths))
    used = [d for d in supply if d]
    record = use.utilization(x.t.drug_exposure, x.t.concept, TARGET_NAMES).first()
    same(record, (np.median(used), np.mean(used), np.mean(n_rx), np.median(n_rx)))


def test_other_drugs(tables):
    x = tables
    members = {r[0] for r in target_rows(x)}
    by_id, by_name, covered = defaultdict(set), defaultdict(set), set()
    for p, d, *_ in x.rx:
        if p in members and d in NAMES:
            if not matches(d, TARGET_NAMES):
                by_id[NAMES[d]].add(p)
                if NAMES[d] is not None:
                    by_name[NAMES[d]].add(p)
            if matches(d, ["prazole"]):
                covered.add(p)
    got = {r["drug"]: (r["patients"], r["pct"]) for r in use.concomitant_by_id(x.t.drug_exposure, x.t.concept).collect()}
    assert got == {d: (len(ps), 100 * len(ps) / len(members)) for d, ps in by_id.items()}
    got = {r["drug"]: r["patients"] for r in use.concomitant_by_name(x.t.drug_exposure, x.t.concept).collect()}
    assert got == {d: len(ps) for d, ps in by_name.items()}
    share = use.comedication_coverage(x.t.drug_exposure, x.t.concept).first()
    same(share, (len(covered), len(members), 100 * len(covered) / len(members)))


def test_switching(tables):
    x = tables
    label = lambda d: "ibuprofen" if matches(d, ["ibuprofen"]) else "naproxen"
    rows = [(p, s, label(d)) for p, d, s, _, _ in target_rows(x)]
    start = {p: min(((s, i) for q, s, i in rows if q == p and s is not None), default=(None, None)) for p, _, _ in rows}
    tagged = use.ingredient_exposures(x.t.drug_exposure, x.t.concept)
    expected = [(p, i, None if s is None else day(s)) for p, (s, i) in start.items()]
    assert values(use.first_ingredient(tagged)) == sorted(expected, key=repr)
    moved = {p for p, s, i in rows if s is not None and i != start[p][1] and 0 < s - start[p][0] <= 365}
    same(use.switching(tagged).first(), (len(start), len(moved), 100 * len(moved) / len(start)))
    counts = Counter(i for _, i in start.values())
    got = {r["ingredient"]: r["patients"] for r in use.starting_ingredient(tagged).collect()}
    assert got == dict(counts)


@pytest.mark.parametrize("days", [0, 1, 30, 364, 365, 400, 2000])
def test_switching_within_any_number_of_days(tables, days):
    x = tables
    label = lambda d: "ibuprofen" if matches(d, ["ibuprofen"]) else "naproxen"
    rows = [(p, s, label(d)) for p, d, s, _, _ in target_rows(x)]
    start = {p: min(((s, i) for q, s, i in rows if q == p and s is not None), default=(None, None)) for p, _, _ in rows}
    moved = {p for p, s, i in rows if s is not None and i != start[p][1] and 0 < s - start[p][0] <= days}
    got = use.switching(use.ingredient_exposures(x.t.drug_exposure, x.t.concept), days).first()
    assert tuple(got)[:2] == (len(start), len(moved))


@pytest.mark.parametrize("days", [0, 1, 30, 90, 364, 2000])
def test_other_drugs_within_any_number_of_days(tables, days):
    x = tables
    members = {r[0] for r in target_rows(x)}
    index = first((p, s) for p, _, s, _, _ in target_rows(x))
    found = defaultdict(set)
    for p, d, s, *_ in x.rx:
        if p in members and d in NAMES and not matches(d, TARGET_NAMES):
            if s is not None and index[p] is not None and 0 <= s - index[p] <= days:
                found[NAMES[d]].add(p)
    got = use.concomitant_by_id(x.t.drug_exposure, x.t.concept, days=days).collect()
    assert {r["drug"]: (r["patients"], r["pct"]) for r in got} == {d: (len(ps), 100 * len(ps) / len(members)) for d, ps in found.items()}


def test_safety(tables):
    x = tables
    index = first((p, s) for p, _, s, _, _ in target_rows(x))
    events = [(p, s) for p, c, s in x.dx if c in (BLEED, 4027663)]
    after = {p for p, s in events if p in index and s is not None and index[p] is not None and s > index[p]}
    never = {p for p, _ in events if p not in index}
    r1, r0 = len(after) / len(index), len(never) / (40 - len(index)) if len(index) < 40 else 0
    row = safety.crude_safety(x.t.drug_exposure, x.t.person, x.t.condition_occurrence, codes(x)).first()
    same(row, (len(index), len(after), 100 * r1, 40 - len(index), len(never), 100 * r0, r1 / r0))

    other = first((p, s) for p, d, s, _, _ in x.rx if matches(d, ["acetaminophen"]) and p not in index)
    first_event = first(events)
    expected = []
    people = {p: (year, sex) for p, year, sex in x.person}
    for arm, members in (("NSAID", index), ("Acetaminophen", other)):
        for p, d in members.items():
            if p in people and people[p][1] in NAMES:
                e = first_event.get(p)
                known = e is not None and d is not None
                sex = NAMES[people[p][1]].upper()
                expected.append((arm, age(d, people[p][0]), sex, int(known and e > d), int(known and e <= d)))
    cohort = cohorts.comparator_cohort(x.t.drug_exposure, x.t.concept)
    got = safety.comparative_rows(cohort, x.t.person, x.t.condition_occurrence, x.t.concept)
    assert values(got) == sorted(expected, key=repr)
    risks = {r["grp"]: (r["n"], r["events"]) for r in safety.group_risks(safety.study_cells(x.t), weight="persons").collect()}
    for arm in ("NSAID", "Acetaminophen"):
        rows = [r for r in expected if r[0] == arm and not r[4]]
        assert risks[arm] == (len(rows), sum(r[3] for r in rows))

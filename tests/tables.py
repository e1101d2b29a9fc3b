"""Handwritten tables for edge cases."""

from datetime import date
from types import SimpleNamespace

TYPES = {
    "person": "person_id bigint, year_of_birth bigint, gender_concept_id bigint",
    "concept": "concept_id bigint, concept_name string",
    "condition_occurrence": "person_id bigint, condition_concept_id bigint, condition_start_date date",
    "drug_exposure": (
        "person_id bigint, drug_concept_id bigint, drug_exposure_start_date date, "
        "drug_exposure_end_date date, days_supply bigint"
    ),
}

FEMALE, MALE, UNKNOWN_SEX = 8532, 8507, 99
IBU, NAP, BOTH, ACET, OMEP, ASPIRIN, NAMELESS, UNMAPPED = 1, 2, 3, 4, 5, 6, 7, 8
CONCEPTS = [
    (IBU, "Ibuprofen 100mg"),
    (NAP, "NAPROXEN 500"),
    (BOTH, "naproxen with ibuprofen"),
    (ACET, "acetaminophen"),
    (OMEP, "Omeprazole"),
    (ASPIRIN, "aspirin"),
    (NAMELESS, None),
    (192671, "Gastrointestinal hemorrhage"),
    (4027663, "Peptic ulcer"),
    (40, "Sinusitis"),
    (FEMALE, "Female"),
    (MALE, "Male"),
]
BLEED = 192671


def day(n):
    """The n-th day after 1 January 2000."""
    return date.fromordinal(date(2000, 1, 1).toordinal() + n)


def rx(person_id, drug, start, end=None, supply=None):
    return (
        person_id,
        drug,
        None if start is None else day(start),
        None if end is None else day(end),
        supply,
    )


def dx(person_id, code, start):
    return person_id, code, None if start is None else day(start)


def cdm(spark, person=(), drugs=(), conditions=(), concept=CONCEPTS):
    rows = {"person": person, "drug_exposure": drugs, "condition_occurrence": conditions, "concept": concept}
    return SimpleNamespace(**{name: spark.createDataFrame(list(rows[name]), TYPES[name]) for name in TYPES})


def people(*ids, born=1960, sex=FEMALE):
    return [(i, born, sex) for i in ids]


def values(df):
    """Rows as tuples, in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)

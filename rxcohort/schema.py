"""Tables, column types and default phenotypes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The clinical tables whose row counts are reported after a load.
CORE_TABLES = (
    "PERSON",
    "VISIT_OCCURRENCE",
    "CONDITION_OCCURRENCE",
    "DRUG_EXPOSURE",
    "MEASUREMENT",
    "OBSERVATION",
    "DEATH",
)

# Columns the operators read, with the type each is cast to on load.
COLUMN_TYPES = {
    "person": {
        "person_id": "bigint",
        "year_of_birth": "bigint",
        "gender_concept_id": "bigint",
    },
    "concept": {
        "concept_id": "bigint",
        "concept_name": "string",
    },
    "condition_occurrence": {
        "person_id": "bigint",
        "condition_concept_id": "bigint",
        "condition_start_date": "date",
    },
    "drug_exposure": {
        "person_id": "bigint",
        "drug_concept_id": "bigint",
        "drug_exposure_start_date": "date",
        "drug_exposure_end_date": "date",
        "days_supply": "bigint",
    },
}

# Default outcome (peptic ulcer, gastrointestinal haemorrhage).
OUTCOME_IDS = (4027663, 192671)

# Default keyword search for bleeding and ulcer conditions.
OUTCOME_KEYWORDS = ("bleed", "ulcer", "hemorrhage", "melena", "hematemesis")

# Default study drugs, comparator, and protective co-medication.
TARGET_NAMES = ("ibuprofen", "naproxen")
COMPARATOR_NAMES = ("acetaminophen",)
COMEDICATION_NAMES = ("prazole",)
ARMS = ("NSAID", "Acetaminophen")

# Named drug presets, label to name substrings.
DRUG_PRESETS = {
    "Nonselective NSAIDs (ibuprofen + naproxen)": ["ibuprofen", "naproxen"],
    "Ibuprofen": ["ibuprofen"],
    "Naproxen": ["naproxen"],
    "Celecoxib (COX-2 selective)": ["celecoxib"],
    "Acetaminophen (non-NSAID reference)": ["acetaminophen"],
}


class Cdm(Protocol):
    """Anything that holds the four tables the operators read."""

    person: DataFrame
    concept: DataFrame
    condition_occurrence: DataFrame
    drug_exposure: DataFrame


def declared(df: DataFrame, table: str) -> DataFrame:
    """Cast the declared columns of ``table`` by name; no row is dropped.

    A missing declared column fails here. A value that does not fit its type
    (``1.9`` for an id, ``true`` for days) fails when the rows are read,
    whatever the session's ANSI setting.
    """
    types = COLUMN_TYPES.get(table.lower())
    if types is None:
        return df
    by_name = {c.lower(): c for c in df.columns}
    missing = [c for c in types if c not in by_name]
    if missing:
        raise ValueError(f"{table}: missing columns {', '.join(missing)}")
    named = {by_name[c]: c for c in types}
    return df.select(
        *[
            _strict(F.col(f"`{c}`"), types[named[c]], named[c]).alias(named[c]) if c in named else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _strict(value: Column, kind: str, name: str) -> Column:
    """``value`` as ``kind``, or an error that names the column and the value."""
    typed = value.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"{name}: not a {kind}: "), value.cast("string")))
    return F.when(value.isNotNull() & typed.isNull(), wrong).otherwise(typed)

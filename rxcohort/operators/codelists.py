"""Code lists: sets of concept ids that define a drug or a condition."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxcohort.functions.text import contains_any, first_match
from rxcohort.plans.lookup import keep_codes


def named(concept: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Dictionary rows whose name contains any keyword: concept_id, concept_name."""
    return concept.where(contains_any(F.col("concept_name"), keywords)).select("concept_id", "concept_name")


def not_named(concept: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Dictionary rows with a name that contains no keyword; a NULL name is left out."""
    return concept.where(~contains_any(F.col("concept_name"), keywords)).select("concept_id", "concept_name")


def labelled(concept: DataFrame, keywords: Sequence[str], label: str = "ingredient") -> DataFrame:
    """Matching ids with the first keyword each name contains: concept_id, label."""
    tagged = concept.select("concept_id", first_match(F.col("concept_name"), keywords).alias(label))
    return tagged.where(F.col(label).isNotNull())


def flagged(concept: DataFrame, lists: Mapping[str, Iterable[str]]) -> DataFrame:
    """Ids in at least one of several lists, with one boolean column per list."""
    flags = {
        name: F.coalesce(contains_any(F.col("concept_name"), keywords), F.lit(False))
        for name, keywords in lists.items()
    }
    rows = concept.select("concept_id", *[test.alias(name) for name, test in flags.items()])
    return rows.where(F.greatest(*[F.col(name) for name in flags], F.lit(False)))


def codelist_by_name(drug_exposure: DataFrame, concept: DataFrame, keywords: Iterable[str]) -> DataFrame:
    """Distinct drug ids in use whose name contains any keyword: drug_concept_id."""
    used = keep_codes(drug_exposure.select("drug_concept_id"), "drug_concept_id", named(concept, keywords))
    return used.distinct()


def codelist_by_ids(facts: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """Fact rows coded with one of the given ids; the list is pushed into the scan."""
    return facts.where(F.col(key).isin(list(ids)))

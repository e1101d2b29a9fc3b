"""Every operator applied to the whole stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcohort.operators import codelists, cohorts, describe, model, safety
from rxcohort.operators import utilization as use
from rxcohort.schema import Cdm
from rxcohort.sources import proxy
from rxcohort.sources.store import core_row_counts, scratch_store, stored


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that two engines can be compared by value."""
    return df.select(
        *[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


def _targets(t: Cdm) -> DataFrame:
    return codelists.named(t.concept, proxy.TARGET)


def _new_users(t: Cdm) -> DataFrame:
    return cohorts.new_user_cohort(t.drug_exposure, _targets(t))


def _tagged(t: Cdm) -> DataFrame:
    return use.ingredient_exposures(t.drug_exposure, t.concept, proxy.TARGET)


def _arms(t: Cdm) -> DataFrame:
    return cohorts.comparator_cohort(t.drug_exposure, t.concept, proxy.TARGET, proxy.COMPARATOR)


def _rows(t: Cdm) -> DataFrame:
    return safety.comparative_rows(_arms(t), t.person, t.condition_occurrence, t.concept, proxy.OUTCOME)


def _cells(t: Cdm) -> DataFrame:
    return safety.study_cells(t, proxy.TARGET, proxy.COMPARATOR, proxy.OUTCOME)


def _risks(t: Cdm) -> DataFrame:
    return safety.group_risks(_cells(t), weight="persons")


def _forest(t: Cdm) -> DataFrame:
    _, crude, adjusted = model.study_estimates(_cells(t))
    return model.forest_rows(crude, adjusted)


def comparative_safety(t: Cdm) -> DataFrame:
    return model.comparative_safety(t, proxy.TARGET, proxy.COMPARATOR, proxy.OUTCOME)


ON_TABLES: dict[str, Callable[[Cdm], DataFrame]] = {
    "top_conditions": lambda t: describe.top_conditions(t.condition_occurrence, t.concept),
    "top_drugs": lambda t: describe.top_drugs(t.drug_exposure, t.concept),
    "keyword_conditions": lambda t: describe.keyword_conditions(
        t.condition_occurrence, t.concept, proxy.CONDITION_KEYWORDS
    ),
    "codelist_by_name": lambda t: codelists.codelist_by_name(t.drug_exposure, t.concept, proxy.TARGET),
    "codelist_by_ids": lambda t: codelists.codelist_by_ids(
        t.condition_occurrence, "condition_concept_id", proxy.OUTCOME
    ),
    "outcome_cohort": lambda t: cohorts.outcome_cohort(t.condition_occurrence, proxy.OUTCOME),
    "new_user_cohort": _new_users,
    "cohort_members": lambda t: cohorts.cohort_members(t.drug_exposure, _targets(t)),
    "cohort_share": lambda t: cohorts.cohort_share(_new_users(t), t.person),
    "age_summary": lambda t: describe.age_summary(_new_users(t), t.person),
    "sex_breakdown": lambda t: describe.sex_breakdown(_new_users(t), t.person, t.concept),
    "age_distribution": lambda t: describe.age_distribution(_new_users(t), t.person),
    "age_histogram": lambda t: describe.age_histogram(describe.age_distribution(_new_users(t), t.person)),
    "age_histogram_fitted": lambda t: describe.age_histogram(
        describe.age_distribution(_new_users(t), t.person), width=None
    ),
    "codelist_products": lambda t: describe.codelist_products(t.drug_exposure, t.concept, proxy.TARGET),
    "nsaid_exposures": lambda t: use.drug_exposures(t.drug_exposure, _targets(t)),
    "rx_per_patient": lambda t: use.rx_per_patient(t.drug_exposure, _targets(t)),
    "treatment_span": lambda t: use.treatment_span(t.drug_exposure, _targets(t)),
    "days_supply_quality": lambda t: use.days_supply_quality(t.drug_exposure, _targets(t)),
    "rx_days_supply_stats": lambda t: use.rx_days_supply_stats(t.drug_exposure, _targets(t)),
    "rx_span_stats": lambda t: use.rx_span_stats(t.drug_exposure, _targets(t)),
    "concomitant_by_id": lambda t: use.concomitant_by_id(t.drug_exposure, t.concept, proxy.TARGET),
    "concomitant_by_name": lambda t: use.concomitant_by_name(t.drug_exposure, t.concept, proxy.TARGET),
    "concomitant_in_window": lambda t: use.concomitant_by_id(t.drug_exposure, t.concept, proxy.TARGET, days=90),
    "comedication_coverage": lambda t: use.comedication_coverage(
        t.drug_exposure, t.concept, proxy.TARGET, proxy.COMEDICATION
    ),
    "ingredient_exposures": _tagged,
    "first_ingredient": lambda t: use.first_ingredient(_tagged(t)),
    "switching": lambda t: use.switching(_tagged(t)),
    "starting_ingredient": lambda t: use.starting_ingredient(_tagged(t)),
    "crude_safety": lambda t: safety.crude_safety(
        t.drug_exposure, t.person, t.condition_occurrence, _targets(t), proxy.OUTCOME
    ),
    "comparator_cohort": _arms,
    "comparative_rows": _rows,
    "comparative_cells": lambda t: safety.comparative_cells(
        _arms(t), t.person, t.condition_occurrence, t.concept, proxy.OUTCOME
    ),
    "incident_filter": lambda t: safety.incident_filter(_rows(t)),
    "dummy_encode": lambda t: safety.dummy_encode(safety.incident_filter(_rows(t))),
    "group_risks": _risks,
    "risk_ratio_ci": lambda t: safety.risk_ratio_ci(_risks(t)),
    "adjusted_odds_ratio": lambda t: model.adjusted_odds_ratio(_cells(t), weight="persons"),
    "cohort_metrics": lambda t: describe.cohort_metrics(t.drug_exposure, t.person, t.concept, proxy.TARGET),
    "utilization": lambda t: use.utilization(t.drug_exposure, t.concept, proxy.TARGET),
    "drug_presets": lambda t: describe.presets_summary(t.drug_exposure, t.person, t.concept, proxy.PRESETS),
    "risk_table": lambda t: safety.risk_table(_risks(t)),
    "forest_rows": _forest,
    "comparative_safety": comparative_safety,
}


def _on_proxy(operator: Callable[[Cdm], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(operator(proxy.ProxyCdm(spark, sf_dir)))


# Operators again on tables that were written to a store first, where a code list reaches the Parquet reader.
ON_STORE = {f"stored_{name}": ON_TABLES[name] for name in ("new_user_cohort", "nsaid_exposures", "comparative_safety")}


def _on_store(operator: Callable[[Cdm], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(operator(stored(spark, proxy.ProxyCdm(spark, sf_dir), scratch_store(spark))))

    return query


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = proxy.ProxyCdm(spark, sf_dir)
    tables = {name: getattr(t, name) for name in ("person", "condition_occurrence", "drug_exposure")}
    return core_row_counts(spark, tables)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "core_row_counts": _row_counts,
        **{name: _on_proxy(op) for name, op in ON_TABLES.items()},
        **{name: _on_store(op) for name, op in ON_STORE.items()},
    }

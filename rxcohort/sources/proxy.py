"""Stand-in patient tables derived from a sales schema.

There is no clinical data at hand, so customers stand for persons, line items
for drug exposures, orders for conditions, and part names for
drug names. ``FIXTURES.md`` section 2 gives the mapping. Drug ids start above
every other id, however many parts there are.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rxcohort.plans.lookup import local_rows

CONDITION_BASE = 2_000_000
FEMALE, MALE = 3_000_001, 3_000_002
DRUG_BASE = 10_000_000

# What stands for the study drugs, comparator, outcome and so on in this mapping.
TARGET = ("hot gear", "red bolt")
COMPARATOR = ("blue",)
COMEDICATION = ("anvil",)
CONDITION_KEYWORDS = ("urgent", "high")
OUTCOME = (2_000_011, 2_000_021)
PRESETS = {
    "Both targets": ["hot gear", "red bolt"],
    "First target": ["hot gear"],
    "Second target": ["red bolt"],
    "Not in use": ["celecoxib"],
    "Comparator": ["blue"],
}


# Columns used of each source table. Stating them spares a look at every file's footer.
SOURCES = {
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_name string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
    ),
}


class ProxyCdm:
    """The four tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def _source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def person(self) -> DataFrame:
        return _person(self._source("customer"))

    @cached_property
    def concept(self) -> DataFrame:
        return _concept(self.spark, self._source("part"), self._source("orders"))

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        return _conditions(self._source("orders"))

    @cached_property
    def drug_exposure(self) -> DataFrame:
        return _exposures(self._source("lineitem"), self._source("orders"))


def _person(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS person_id",
        "CAST(1940 + c_custkey * 7 % 50 AS BIGINT) AS year_of_birth",
        f"CAST(IF(c_nationkey % 2 = 0, {FEMALE}, {MALE}) AS BIGINT) AS gender_concept_id",
    )


CONDITION_ID = f"""CAST(
    {CONDITION_BASE} + 10 * CAST(substring(o_orderpriority, 1, 1) AS BIGINT)
    + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT)"""


def _concept(spark: SparkSession, part: DataFrame, orders: DataFrame) -> DataFrame:
    drugs = part.selectExpr(f"{DRUG_BASE} + p_partkey AS concept_id", "p_name AS concept_name")
    conditions = (
        orders.select("o_orderpriority", "o_orderstatus")
        .distinct()
        .selectExpr(CONDITION_ID, "o_orderpriority || ' ' || o_orderstatus")
    )
    sexes = local_rows(spark, "concept_id bigint, concept_name string", [(FEMALE, "Female"), (MALE, "Male")])
    return drugs.union(conditions).union(sexes)


def _conditions(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_custkey AS person_id",
        f"{CONDITION_ID} AS condition_concept_id",
        "CAST(o_orderdate AS DATE) AS condition_start_date",
    )


def _exposures(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return lineitem.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").selectExpr(
        "o_custkey AS person_id",
        f"{DRUG_BASE} + l_partkey AS drug_concept_id",
        "CAST(l_shipdate AS DATE) AS drug_exposure_start_date",
        "IF(l_linenumber <> 1, date_add(CAST(l_shipdate AS DATE), CAST(l_quantity AS INT)), NULL)"
        " AS drug_exposure_end_date",
        "CAST(CASE l_linenumber WHEN 3 THEN 0 WHEN 2 THEN NULL ELSE l_quantity END AS BIGINT) AS days_supply",
    )

"""The Parquet store and its row counts."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce
from types import SimpleNamespace
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcohort.plans.lookup import local_rows
from rxcohort.schema import COLUMN_TYPES, CORE_TABLES, Cdm

# The column facts are clustered by, so that a code list skips most row groups.
CODE_COLUMN = {"condition_occurrence": "condition_concept_id", "drug_exposure": "drug_concept_id"}


def write_table(df: DataFrame, store: str, table: str) -> None:
    """Replace one table of the store: written beside it, then renamed.

    A write that fails leaves the old table as it was.

    Fact tables are range-clustered by code and then person: a code list reads
    few row groups, and a code with very many rows is spread over many files.
    """
    code = CODE_COLUMN.get(table.lower())
    if code is not None:
        df = df.repartitionByRange(F.col(code), F.col("person_id")).sortWithinPartitions(code, "person_id")
    path = table_path(store, table)
    fresh = table_path(store, f"_{table}-{uuid4().hex}")
    try:
        df.write.parquet(fresh)
    except Exception:
        _files(df.sparkSession, fresh).remove()
        raise
    _swap(df.sparkSession, fresh, path)


class _files:
    """One path of whatever file system it lies in; renames are atomic per folder where the system has them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self) -> bool:
        return self.system.exists(self.at)

    def move(self, to: _files) -> None:
        if not self.system.rename(self.at, to.at):
            raise OSError(f"cannot rename {self.at} to {to.at}")

    def remove(self) -> None:
        self.system.delete(self.at, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at ``path``, if anything."""
    _files(spark, path).remove()


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a finished folder in the place of another, which stays readable until then."""
    new, current, old = (_files(spark, p) for p in (fresh, path, f"{fresh}-old"))
    replaces = current.exists()
    if replaces:
        current.move(old)
    try:
        new.move(current)
    except Exception:
        if replaces:
            old.move(current)
        raise
    if replaces:
        old.remove()


def scratch_store(spark: SparkSession) -> str:
    """A new store for one job in the folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; on a
    cluster there is nothing safe to fall back on, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rxcohort-")
    return f"{folder.rstrip('/')}/store-{uuid4().hex}"


def stored(spark: SparkSession, tables: Cdm, store: str) -> Cdm:
    """``tables`` written to a store, clustered as every table of a store is, and read back from there."""
    for name in COLUMN_TYPES:
        write_table(getattr(tables, name), store, name)
    return read_cdm(spark, store)


def table_path(store: str, table: str) -> str:
    """Tables are stored under their lower-case name: names are case-insensitive."""
    return f"{store.rstrip('/')}/{table.lower()}"


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(store, table))


def has_table(spark: SparkSession, store: str, table: str) -> bool:
    try:
        read_table(spark, store, table)
    except AnalysisException:
        return False
    return True


def read_cdm(spark: SparkSession, store: str, views: bool = False) -> Cdm:
    """The tables the operators read; with ``views`` also as temporary views of the same names."""
    tables = {name: read_table(spark, store, name) for name in COLUMN_TYPES}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return SimpleNamespace(**tables)


def core_row_counts(
    spark: SparkSession, tables: Mapping[str, DataFrame], names: Sequence[str] = CORE_TABLES
) -> DataFrame:
    """Rows of each core table, NULL if it is absent: table, n."""
    present = {name.lower(): df for name, df in tables.items()}
    absent = local_rows(spark, "table string, n bigint", [(name, None) for name in names if name.lower() not in present])
    counted = [
        present[name.lower()].agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        for name in names
        if name.lower() in present
    ]
    return reduce(DataFrame.unionByName, counted, absent)

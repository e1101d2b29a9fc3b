"""Every registered query against its SQL: same columns, types and multiset of rows."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from rxcohort.catalog.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def sorted_by_column(table):
    return table.select(sorted(table.column_names))


def rows_of(table):
    return Counter(tuple(row.values()) for row in sorted_by_column(table).to_pylist())


def test_every_query_has_sql():
    """All of the library; of the optional queries only those that SQL can express have some."""
    assert set(all_queries()) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert [f.type for f in sorted_by_column(ours).schema] == [f.type for f in sorted_by_column(theirs).schema]
    assert rows_of(ours) == rows_of(theirs)


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 1

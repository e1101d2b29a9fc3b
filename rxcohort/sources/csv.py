"""Loading a directory of CSV tables into the Parquet store."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxcohort.plans.lookup import local_rows
from rxcohort.schema import COLUMN_TYPES, declared
from rxcohort.sources.store import CODE_COLUMN, remove, table_path, write_table

STATUS_SCHEMA = "table string, path string, loaded boolean, error string"

# Separators tried on the header line.
SEPARATORS = (",", "\t", "|", ";")


def _literal(path: str) -> str:
    """A listed path as a pattern that matches only itself."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def discover_csv(spark: SparkSession, directory: str) -> DataFrame:
    """CSV files anywhere below a directory: path, folder, table (upper-case file stem).

    Hidden files, such as the ``._*`` companions some systems add, are skipped
    by the file source. Only the listing is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .load(directory)
        .select("path")
    )
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.upper(F.element_at(parts, -2)).alias("folder"),
        F.upper(F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "")).alias("table"),
    ).orderBy(parts)


def _separator(spark: SparkSession, path: str) -> str:
    """The candidate that splits the header line into most columns."""
    header = spark.read.text(_literal(path)).first()
    line = header[0] if header else ""
    return max(SEPARATORS, key=line.count)


def raw_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """One CSV file, or several with the same header, all columns as text and empty fields NULL.

    Only the first lines are read here. Quotes inside quoted fields are
    doubled; a row of the wrong width or a file with another header fails the
    read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = [_literal(p) for p in paths]
    reader = (
        spark.read.option("header", "true")
        .option("mode", "FAILFAST")
        .option("sep", _separator(spark, paths[0]))
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", "false")
        .option("multiLine", str(multi_line).lower())
    )
    names = reader.csv(files[0]).columns
    if not names:
        return reader.csv(files)
    df = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in names])).csv(files)
    return df.select(*[F.nullif(F.col(f"`{name}`"), F.lit("")).alias(name) for name in names])


# How a number, a date and a moment are written, for telling the type of undeclared columns.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^NaN$|^[+-]?Inf$"
KINDS = {
    "int": r"^[+-]?[0-9]{1,10}$",
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": NUMBER,
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$",
    "boolean": r"^(?i)(true|false)$",
}


def inferred(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The first of ``KINDS`` that every value of a text column is written as, else string, in one aggregation."""

    def fits(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        written = F.when(value.isNotNull(), value.rlike(KINDS[kind]) & value.try_cast(kind).isNotNull())
        return F.coalesce(F.bool_and(written), F.lit(False))

    if not names:
        return {}
    tests = [(name, kind) for name in names for kind in KINDS]
    found = df.agg(*[fits(name, kind) for name, kind in tests]).first()
    types = dict.fromkeys(names, "string")
    for (name, kind), every in reversed(list(zip(tests, found))):
        if every:
            types[name] = kind
    return types


def undeclared(df: DataFrame, table: str) -> list[str]:
    known = COLUMN_TYPES.get(table.lower(), {})
    return [name for name in df.columns if name.lower() not in known]


def typed(raw: DataFrame, table: str) -> DataFrame:
    """Text columns of a table as their types: declared ones cast strictly by name, others as ``inferred``."""
    types = inferred(raw, undeclared(raw, table))
    columns = [F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in raw.columns]
    return declared(raw.select(*columns), table)


def read_csv(spark: SparkSession, paths: str | Sequence[str], table: str, multi_line: bool = False) -> DataFrame:
    """One table from one CSV file or several with the same header, declared columns cast by name.

    Declared columns are read as text and cast strictly; types of other
    columns, if there are any, are inferred in one more pass. Set
    ``multi_line`` for files with line breaks inside fields; such a file
    cannot be split among tasks.
    """
    return typed(raw_csv(spark, paths, multi_line), table)


@contextmanager
def parsed_once(raw: DataFrame, store: str, table: str) -> Iterator[DataFrame]:
    """``raw``, written as it is where it would be read more than once, so that each line of CSV is parsed once.

    Telling types of undeclared columns and finding the ranges of a fact table
    then read a few columns of Parquet. What is written goes at the end.
    """
    if not undeclared(raw, table) and table.lower() not in CODE_COLUMN:
        yield raw
        return
    path = table_path(store, f"_{table}-{uuid4().hex}-text")
    try:
        raw.write.parquet(path)
        yield raw.sparkSession.read.schema(raw.schema).parquet(path)
    finally:
        remove(raw.sparkSession, path)


def _load_table(
    spark: SparkSession, table: str, sources: list[tuple[str, ...]], store: str, multi_line: bool
) -> list[tuple]:
    """Load the last readable source of one table, a file or all parts of a folder; a status row per file."""
    status, loaded = [], None
    for paths in reversed(sources):
        if loaded is not None:
            status.extend((table, path, False, f"replaced by {loaded}") for path in paths)
            continue
        try:
            with parsed_once(raw_csv(spark, paths, multi_line), store, table) as text:
                write_table(typed(text, table), store, table)
        except Exception as error:  # must not stop the other files
            status.extend((table, path, False, str(error).split("\n")[0]) for path in paths)
        else:
            loaded = paths[0]
            status.extend((table, path, True, None) for path in paths)
    return status


def load_cdm(
    spark: SparkSession,
    directory: str,
    store: str,
    multi_line: Iterable[str] = (),
    parallel: int = 4,
    in_parts: Iterable[str] = (),
) -> DataFrame:
    """Load every CSV file into the store: table, path, loaded, error.

    A file that cannot be read or typed is reported and skipped. Of several
    files with the same stem the last readable one by path is loaded and the
    others are reported. Tables named in ``in_parts`` come in many files: all
    files of a folder of the table's name, whatever they are called, are read
    together as that table. Every line is parsed once, in a single pass over
    all files of a table; first lines are looked at before. Loading again replaces. The loading is done when
    this is called; the result has one row per file.
    """
    quoted, parted = ({name.upper() for name in names} for names in (multi_line, in_parts))
    by_table: dict[str, dict[str, list[str]]] = {}
    for row in discover_csv(spark, directory).collect():
        whole = row["folder"] in parted
        table, source = (row["folder"], row["path"].rsplit("/", 1)[0]) if whole else (row["table"], row["path"])
        by_table.setdefault(table, {}).setdefault(source, []).append(row["path"])

    def load(table: str) -> list[tuple]:
        sources = [tuple(paths) for paths in by_table[table].values()]
        return _load_table(spark, table, sources, store, table in quoted)

    with ThreadPoolExecutor(parallel) as pool:
        status = [row for rows in pool.map(load, by_table) for row in rows]
    return local_rows(spark, STATUS_SCHEMA, status)

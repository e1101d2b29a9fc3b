"""What several operators share: written intermediate tables and worker-held objects."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a new temporary folder; on
    a cluster there is nothing safe to fall back on, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rxcohort-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage and survives lost executors. The files belong to the
    caller's job and may go when its result has been written.
    """
    path = f"{shared_folder(df.sparkSession)}/rxcohort-{uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Parts of one schema, at least one, written one after the other to one folder and read back together."""
    job, path = uuid4().hex, None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or f"{shared_folder(spark)}/rxcohort-{job}/{name}"
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts may be long, handed to Python workers in small batches.

    A batch is held whole by both sides, and Spark bounds it by rows only. A
    session that sets another size than Spark's own keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS, "10000") == "10000":
        conf.set(BATCH_ROWS, "500")
    return df


def held(key: object, build: Callable[[], object]) -> object:
    """An object that a Python worker builds once and keeps between tasks."""
    holder = sys.modules.setdefault("_rxcohort_held", types.ModuleType("_rxcohort_held"))
    store = holder.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = build()
    return store[key]


def in_slices(batches: Iterator, most: int = 500, octets: int = 8 << 20) -> Iterator:
    """Arrow batches cut into slices, so long texts don't pile up as Python objects."""
    for batch in batches:
        rows = max(1, min(most, octets * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def doc_fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds

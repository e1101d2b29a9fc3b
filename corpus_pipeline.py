"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame, which ``run`` writes as Parquet and reads again
as the next stage's docs. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcohort.llm import mixing, packing, pii, simhash, toxicity
from rxcohort.llm.common import kept, unused

# Target weights of the labelled quality classes.
QUALITY_WEIGHTS = {"1": 0.9, "0": 0.1}

# SQL can express neither the trained models nor the packing; tests compare
# the stages with plain versions instead.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not call toxic.

    Null and empty texts are scored too; repeated rows go or stay together; an
    empty table stays empty. Columns pass through, whatever their names.
    """
    score = unused(docs.columns, "toxic_score")
    model = toxicity.train(docs, _labels(spark, sf_dir))
    scored = toxicity.with_scores(docs, model, score=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id.

    A row without an id gets one from its text, above all real ids. Rows that
    share an id stand or fall together, and of those with one text one stays.
    Texts without words form a group. An empty table stays empty, and columns
    pass through, whatever their names.
    """
    key, same = unused(docs.columns, "key"), unused(docs.columns, "same")
    own = F.pmod(F.xxhash64("text"), F.lit(1 << 60)) + F.lit(1 << 61)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))
    groups = simhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    stay = kept(groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct(), "stay")
    left = keyed.join(stay, key, "left_semi").withColumn(same, F.xxhash64("text"))
    return left.dropDuplicates([key, same]).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and n_chars to match; every row stays, edge cases as in ``redacted``."""
    masked = pii.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that quality classes meet their weights in expected tokens; none is lost.

    This puts back copies: with rates of at least one, a class below its weight
    is repeated and the other left as it is. Edge cases as in ``mixing.mixed``.
    """
    quality = F.col("quality").cast("string")
    return mixing.mixed(docs, _labels(spark, sf_dir), quality, QUALITY_WEIGHTS, least=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; each row of docs, repeated or without an id, has its pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxcohort.llm import (
    conversations,
    embeddings,
    fingerprints,
    manifest,
    mixing,
    packing,
    pii,
    search,
    secrets,
    simhash,
    substrings,
    token_counts,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Target weights of op1, by quality and toxicity of the labelled table.
MIX = {"q1_t0": 0.80, "q0_t0": 0.12, "q1_t1": 0.06, "q0_t1": 0.02}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    domain = F.concat(F.lit("q"), F.col("quality"), F.lit("_t"), F.col("toxic"))
    return mixing.mix(docs, labels, domain, MIX)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is taken for an owner, and its documents in one language for a repository."""
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the whole texts of all documents whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(search.every_twentieth(F.col("doc_id"))).withColumnRenamed("doc_id", "query_id")
    return search.top_k(docs, queries, k=10)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.checked(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mixing,
            op2_substring_dedup,
            op3_secret_ownership,
            op4_toxicity,
            op5_embedding_near_dedup,
            op6_pii,
            op7_best_fit_packing,
            op8_simhash_near_dedup,
            op9_bm25_top_k,
            op10_token_counts,
            op11_document_fingerprints,
            op12_conversation_trie,
            op13_merkle_manifest,
        )
    }

"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm, mixing, pieces, pii, quality, secrets, simhash, substring, vectors
from .common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per unit to remove, so that documents without one don't appear."""
    return substring.repeated_units(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(documents(spark, sf_dir)))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(documents(spark, sf_dir), quality_domains(spark, sf_dir))


def quality_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table as (doc_id, domain): a domain is a pair of the two labels; null where one is missing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string")).alias("domain"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}

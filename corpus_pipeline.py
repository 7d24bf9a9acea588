"""The corpus pipeline: stages over documents, each written and read again by the next.

Each stage works on all rows that its predecessor kept. All but the last return
the columns of documents; the last returns the documents as piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brevis.llm import langid, mixing, pieces, pii, simhash
from brevis.llm.common import documents, written
from brevis.llm.queries import quality_domains


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return langid.drop_rejected(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their rates say."""
    return mixing.mix(docs, quality_domains(spark, sf_dir))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, sampled and lossless."""
    return pieces.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", personal_data),
    ("mixing", mixing_to_targets),
    ("sentencepiece", sentencepiece),
]

#: Trained models, fingerprints and sampling aren't SQL: the pipeline is tested against its parts and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

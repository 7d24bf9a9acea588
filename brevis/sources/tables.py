"""The engine's tables from Parquet, and the sentence table that most operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.stem import stem_arrays

from .scratch import kept

#: Tables of texts, and the key that deals their rows to tasks where the files are fewer than the cores.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; rows of texts are dealt to all cores where a few files would leave most of them idle, which never happens to a large table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, TEXTS[name]) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as topic documents: a topic is a source with a docset, A and B for alternating blocks of 32 ids."""
    docs = table(spark, sf_dir, "documents")
    docset = F.when(F.floor(F.col("doc_id") / 32) % 2 == 0, "A").otherwise("B")
    return docs.select(F.concat_ws("-", "source", docset).alias("topic_id"), "source", docset.alias("docset"), "doc_id", "text", "lang")


def sentences(docs: DataFrame, keys: tuple[str, ...] = ("topic_id", "doc_id")) -> DataFrame:
    """(keys, ord, orig, tok, length): ord counts a document's sentences from 0. Row-wise, without a shuffle."""
    split = docs.select(*keys, F.posexplode(T.split_sentences(F.col("text"))).alias("ord", "orig"))
    return split.select(*keys, "ord", "orig", T.tokenize(F.col("orig")).alias("tok"), T.n_words(F.col("orig")).alias("length"))


def topic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, docset, doc_id, ord, orig, tok, length) of all topic documents, split and tokenised once an application."""
    return kept(lambda: sentences(topics(spark, sf_dir), ("topic_id", "docset", "doc_id")), "sentences", f"{sf_dir}/documents.parquet", spark)


def stemmed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_sentences with tok stemmed: in one pass without a shuffle, stored once an application."""
    return kept(lambda: topic_sentences(spark, sf_dir).withColumn("tok", stem_arrays(F.col("tok"))), "stems", f"{sf_dir}/documents.parquet", spark)


def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, query): each topic's query text is the benchmark item whose id is the topic's number modulo the items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    ids = topics(spark, sf_dir).select("topic_id", "source").distinct().withColumn("item_id", F.regexp_extract("source", "([0-9]+)$", 1).cast("long"))
    return ids.join(items, "item_id").select("topic_id", "query")

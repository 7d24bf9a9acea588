"""Orders of chosen sentences, retrieval of further documents, and pairwise-redundancy selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.functions import text as T

from .selection import pairwise


def by_date(chosen: DataFrame) -> DataFrame:
    """chosen(topic_id, date_key, ord) with pos, by date and place; a summary's few rows are a group."""
    return chosen.withColumn("pos", F.row_number().over(W.partitionBy("topic_id").orderBy("date_key", "ord")))


def dendrogram_order(words: list[set[str]], together: dict[tuple[str, str], float], centre: set[str]) -> list[int]:
    """Sentences agglomerated by mean co-occurrence; a node's child that is more like `centre` comes first."""
    clusters = [([i], w) for i, w in enumerate(words)]

    def near(a: set[str], b: set[str]) -> float:
        return sum(together.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / max(1, len(a) * len(b))

    def like(w: set[str]) -> float:
        return len(w & centre) / max(len(w), len(centre), 1)

    while len(clusters) > 1:
        _, i, j = max((near(clusters[i][1], clusters[j][1]), -i, -j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        a, b = clusters[-i], clusters[-j]
        first, second = (a, b) if like(a[1]) >= like(b[1]) else (b, a)
        clusters = [c for k, c in enumerate(clusters) if k not in (-i, -j)] + [(first[0] + second[0], a[1] | b[1])]
    return clusters[0][0] if clusters else []


def expand_documents(docs: DataFrame, queries: DataFrame, stop: tuple[str, ...], n: int = 10) -> DataFrame:
    """(topic_id, doc_id, score): the n documents with the largest tf-idf sum over a topic's query words, ties by id."""
    q = queries.select("topic_id", F.explode(F.array_distinct(T.without_stopwords(T.tokenize(F.col("query")), stop))).alias("word"))
    w = docs.select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("word"))
    tf = w.join(q.select("word").distinct(), "word", "left_semi").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("word", F.log(F.col("n") / F.col("df")).alias("idf"))
    s = tf.join(idf, "word").join(q, "word").groupBy("topic_id", "doc_id").agg(F.round(F.sum((1 + F.log("tf")) * F.col("idf")), 9).alias("score"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("r") <= n).drop("r")


def select_pairwise(sents: DataFrame, budget: int = 100, cutoff: int = 10) -> DataFrame:
    """(topic_id, doc_id, ord): sentences with the most relevance less the cosine of each ordered pair, from the `cutoff` most relevant of a topic.

    sents(topic_id, doc_id, ord, length, words, relevance). The cutoff is the model's own; it bounds a task and its search, which sees every set of ten.
    """
    top = sents.withColumn("r", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("relevance"), "doc_id", "ord"))).filter(F.col("r") <= cutoff)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "ord"]).reset_index(drop=True)
        names = sorted({w for ws in pdf["words"] for w in ws})
        at = {w: i for i, w in enumerate(names)}
        x = np.zeros((len(pdf), max(1, len(names))))
        for i, ws in enumerate(pdf["words"]):
            for w in ws:
                x[i, at[w]] += 1
        norm = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
        cos = (x @ x.T) / norm[:, None] / norm[None, :]
        return pdf.loc[pairwise(pdf["relevance"].to_numpy(), cos, list(pdf["length"]), budget), ["topic_id", "doc_id", "ord"]]

    return top.select("topic_id", "doc_id", "ord", "length", "words", "relevance").groupBy("topic_id").applyInPandas(solve, "topic_id string, doc_id long, ord int")

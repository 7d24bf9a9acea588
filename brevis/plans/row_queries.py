"""Queries over stateful text rules, retrieval and pairwise selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevis.functions import rows, text as T
from brevis.operators import ordering
from brevis.sources.tables import sentences, table, topic_queries, topic_sentences, topics

from .concept_queries import STOPWORDS, overlapped
from .registry import QUERIES_CTE, TOPICS, query, tokens


@query(None)
def kept_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(rows.kept_sentences(T.split_sentences(F.col("text")))).alias("ord", "sentence"))


@query(None)
def treebank_tokens(spark, d):
    s = topic_sentences(spark, d)
    return s.select("doc_id", "ord", rows.treebank(F.col("orig")).alias("toks")).select("doc_id", "ord", "toks", rows.detokenized(F.col("toks")).alias("again"))


@query(f"""WITH {TOPICS}, {QUERIES_CTE}, q AS (SELECT topic_id, unnest(q) AS word FROM queries), w AS (SELECT doc_id, unnest({tokens('text')}) AS word FROM topics), tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM q) GROUP BY ALL),
idf AS (SELECT word, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY 1), s AS (SELECT topic_id, doc_id, round(sum((1 + ln(tf)) * idf), 9) AS score FROM tf JOIN idf USING (word) JOIN q USING (word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS r FROM s) SELECT topic_id, doc_id, score FROM r WHERE r <= 10""")
def expand_topics(spark, d):
    """Ten further documents a topic, by tf-idf of its query words."""
    return ordering.expand_documents(table(spark, d, "documents"), topic_queries(spark, d), STOPWORDS)


@query(None)
def select_pairwise(spark, d):
    s = overlapped(spark, d).filter("length between 5 and 40 and overlap > 0")
    return ordering.select_pairwise(s.withColumn("relevance", F.col("overlap") / F.col("length") + F.when(F.col("ord") == 0, 1).otherwise(0)))

"""Registered queries read all of their input."""

import os

import pytest

from brevis.plans import classify_queries as Q
from brevis.plans import concept_queries, row_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_topics_cover_all_languages_sentences_and_words(spark):
    from brevis.functions import text as T
    from brevis.sources.tables import sentences, topics
    from pyspark.sql import functions as F

    words = sentences(topics(spark, DATA)).select("doc_id", F.explode(T.without_stopwords(F.col("tok"), T.stopwords())).alias("w"))
    shared = words.groupBy("w").agg(F.countDistinct("doc_id").alias("n")).filter("n >= 2").count()
    _, size = Q.topic_model(spark, DATA)
    assert size == shared > 5000


@pytest.mark.parametrize("name", ["select_greedy", "select_swap", "summarize", "select_pairwise"])
def test_selection_covers_both_docsets(spark, name):
    q = getattr(row_queries if name == "select_pairwise" else concept_queries, name)
    assert {r["topic_id"][-1] for r in q(spark, DATA).select("topic_id").distinct().collect()} == {"A", "B"}

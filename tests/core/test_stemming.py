"""The production path works on stems."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.stem import stem
from brevis.operators import concepts as C
from brevis.plans import concept_queries as Q
from brevis.sources.tables import topic_queries, topic_sentences

DATA = "/root/testdata/sf0.01"


def test_irregular_words_bypass_the_rules():
    assert [stem(w) for w in ("skies", "Dying", "news", "innings", "howe", "proceed", "go")] == ["sky", "die", "news", "inning", "howe", "proceed", "go"]


def test_query_words_lose_stopwords_before_stemming_and_sentences_after(spark):
    # "being" is no stopword of this list but its stem is: the query keeps the stem, the sentence loses it
    sents = spark.createDataFrame([("t", ["be", "talk"]), ("u", ["talk"]), ("v", [])], "topic_id string, words array<string>")
    queries = spark.createDataFrame([("t", "Being talks the"), ("u", None)], "topic_id string, query string")
    got = {r["topic_id"]: r["overlap"] for r in C.with_overlap(sents, queries, ("be", "the"), stem=True).collect()}
    assert got == {"t": 1, "u": 0, "v": 0}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stemmed_weights_match_counts_made_apart(spark):
    stop = set(T.stopwords())
    asked = {r["topic_id"]: {stem(w) for w in r["w"] if w not in stop} for r in topic_queries(spark, DATA).select("topic_id", T.tokenize(F.col("query")).alias("w")).collect()}
    marks = defaultdict(set)
    for r in topic_sentences(spark, DATA).collect():
        rule, stems = C.RULES[r["docset"]], [stem(w) for w in r["tok"]]
        if len({w for w in stems if w not in stop} & asked.get(r["topic_id"], set())) >= rule.overlap:
            for pair in zip(stems, stems[1:], strict=False):
                marks[r["topic_id"], pair].add((r["doc_id"], r["ord"] == 0))
    want = {}
    for (topic, pair), seen in marks.items():
        rule = C.RULES[topic[-1]]
        weight = len(seen) + rule.first * sum(first for _, first in seen)
        if weight >= rule.least and not set(pair) <= stop:
            want[topic, "_".join(pair)] = weight
    got = {(r["topic_id"], r["concept"]): r["weight"] for r in Q.concept_weights_stemmed(spark, DATA).collect()}
    assert {topic[-1] for topic, _ in want} == {"A", "B"} and got == want

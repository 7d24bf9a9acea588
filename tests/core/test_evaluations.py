"""Text rules compute what they are given once a row."""

from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions import tokenizers as K
from brevis.operators import concepts as C


def _times(df, part: str) -> int:
    return df._jdf.queryExecution().analyzed().toString().count(part)


def test_units_tokenise_a_text_once(spark):
    """A text of gold words used to be tokenised again for every word that it has."""
    gold = spark.createDataFrame([("t", 1, "a b a b"), ("t", 2, "b a, c")], "topic_id string, annotator long, text string")
    w = C.gold_weights(gold)
    assert _times(w, "lower(") == 1
    assert {(r["concept"], r["weight"]) for r in w.collect()} == {("a_b", 1), ("b_a", 2), ("a_c", 1)}
    for unit in T.UNITS:
        assert _times(gold.select(T.units(T.tokenize(F.col("text")), unit).alias("x")), "lower(") == 1
    assert _times(gold.select(K.alnum_bigrams(F.split("text", " ")).alias("x")), "[a-zA-Z0-9]") == 1


def test_cleaning_computes_each_rule_once(spark):
    """A rule used to be computed again wherever its result stood in the next ones, some hundred times in all."""
    lines = spark.createDataFrame([("x",)], "s string")
    for rule in (T.clean_sentence, T.clean_aggressive):
        assert _times(lines.select(rule(F.col("s")).alias("x")), "monday|") == 1


def test_wordings_are_cleaned_once(spark):
    s = "On Monday the two delegations met again in the old capital for talks about grain, he said."
    sents = spark.createDataFrame([("t", 1, 0, s)], "topic_id string, doc_id long, ord int, orig string")
    v = C.variants(sents)
    assert _times(v, "monday|") == 1
    assert [r["orig"] for r in v.orderBy("variant").collect()] == [s, "The two delegations met again in the old capital for talks about grain."]


def test_a_topic_never_meets_in_a_join(spark):
    """Joins of sentences or concepts by topic alone used to sort a whole topic in a task."""
    sents = spark.createDataFrame([("t", 1, 0, ["a", "b"], 2)], "topic_id string, doc_id long, ord int, words array<string>, overlap int")
    queries = spark.createDataFrame([("t", "b c")], "topic_id string, query string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (C.with_overlap(sents.drop("overlap"), queries, ("x",)), C.df_or_tf(sents), C.sentence_values(sents), C.document_reinforcement(C.occurrences(sents))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)

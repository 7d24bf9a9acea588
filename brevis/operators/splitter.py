"""Sentence boundaries as a classification of words that end in a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smoothing of a feature's count, and the weight of the prior.
SMOOTH, PRIOR_POWER = 0.1, 4


def period_statistics(docs: DataFrame) -> DataFrame:
    """(word, dotted, n, share): how often a lower-cased word, its final periods aside, has one."""
    w = docs.select(F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("w")).filter("w <> ''")
    c = w.groupBy(F.lower(F.rtrim("w", F.lit("."))).alias("word")).agg(F.count_if(F.col("w").endswith(".")).alias("dotted"), F.count("*").alias("n"))
    return c.withColumn("share", F.col("dotted") / F.col("n"))


def fragments(docs: DataFrame) -> DataFrame:
    """(doc_id, at, features, label): a row per word that ends in a period; label: it ends its line.

    Features look at the word, at the next one and at both; made within the document's row.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    w = lines.select("doc_id", "line", F.filter(F.split("t", "[ \\t]+"), lambda x: x != "").alias("w"))
    each = w.select("doc_id", "line", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"), "w").filter(F.col("word").endswith("."))
    nxt = F.coalesce(F.get("w", F.col("i") + 1), F.lit(""))
    x, y = F.lower(F.rtrim("word", F.lit("."))), F.lower(F.regexp_replace(nxt, "[^A-Za-z]", ""))
    upper = nxt.rlike("^[^A-Za-z]*[A-Z]").cast("string")
    f = F.array(F.concat(F.lit("w1="), x), F.concat(F.lit("w2="), y), F.concat(F.lit("len="), F.least(F.length(x), F.lit(10))), F.concat(F.lit("up="), upper), F.concat(F.lit("both="), x, F.lit(" "), y), F.concat(F.lit("w1up="), x, F.lit(" "), upper))
    return each.select("doc_id", "line", F.col("i").alias("at"), f.alias("features"), (F.col("i") + 1 == F.col("n")).alias("label"))


def train(frags: DataFrame) -> DataFrame:
    """(feature, yes, no): log likelihoods, all feature kinds pooled; the row of the null feature holds the log priors."""
    c = frags.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if("label").alias("y"), F.count_if(~F.col("label")).alias("n"))
    t = c.agg(F.sum("y").alias("ty"), F.sum("n").alias("tn"), F.count("*").alias("k"))
    j = c.crossJoin(F.broadcast(t))
    like = lambda a, b: F.log((F.col(a) + SMOOTH) / (F.col(b) + SMOOTH * F.col("k")))
    prior = t.select(F.lit(None).cast("string").alias("feature"), F.log((F.col("ty") + SMOOTH) / (F.col("ty") + F.col("tn"))).alias("yes"), F.log((F.col("tn") + SMOOTH) / (F.col("ty") + F.col("tn"))).alias("no"))
    return j.select("feature", like("y", "ty").alias("yes"), like("n", "tn").alias("no")).unionAll(prior)


def score(frags: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, line, at, label, p): the posterior of a boundary; features that the model lacks are skipped."""
    prior = model.filter("feature is null").select(F.col("yes").alias("py"), F.col("no").alias("pn"))
    f = frags.select("doc_id", "line", "at", "label", F.explode("features").alias("feature"))
    s = f.join(model.filter("feature is not null"), "feature", "left").groupBy("doc_id", "line", "at", "label").agg(F.coalesce(F.sum("yes"), F.lit(0.0)).alias("y"), F.coalesce(F.sum("no"), F.lit(0.0)).alias("n"))
    odds = (F.col("n") + PRIOR_POWER * F.col("pn")) - (F.col("y") + PRIOR_POWER * F.col("py"))
    return s.crossJoin(F.broadcast(prior)).select("doc_id", "line", "at", "label", (1 / (1 + F.exp(odds))).alias("p"))

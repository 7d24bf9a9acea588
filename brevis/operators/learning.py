"""Classifiers, attribute measures, discretisation and folds, as count tables and joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.sources.scratch import stored


def long_form(rows: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """(attribute, value, label), one row per row and attribute; null values are the string "?"."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("?")).alias("value")) for a in attributes])
    return rows.select(F.explode(pairs).alias("p"), F.col(label).cast("string").alias("label")).select("p.attribute", "p.value", "label")


def value_counts(rows: DataFrame, attributes: list[str], label: str) -> DataFrame:
    return long_form(rows, attributes, label).groupBy("attribute", "value", "label").agg(F.count("*").alias("n"))


def majority(rows: DataFrame, label: str) -> DataFrame:
    """(label, n): the commonest label, the first by name on ties."""
    c = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "label").limit(1)


def one_rule(counts: DataFrame) -> DataFrame:
    """(attribute, error): the share of rows that the majority label of each value gets wrong."""
    v = counts.groupBy("attribute", "value").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return v.groupBy("attribute").agg(((F.sum("n") - F.sum("top")) / F.sum("n")).alias("error"))


def stump_measures(counts: DataFrame) -> DataFrame:
    """(attribute, information_gain, split_info, gain_ratio); split information counts each value once more."""
    plogp = lambda n, t: -(n / t) * F.log2(n / t)
    by_label = counts.groupBy("attribute", "label").agg(F.sum("n").alias("n"))
    total = counts.groupBy("attribute").agg(F.sum("n").alias("t"))
    root = by_label.join(total, "attribute").groupBy("attribute").agg(F.sum(plogp(F.col("n"), F.col("t"))).alias("root"))
    size = counts.groupBy("attribute", "value").agg(F.sum("n").alias("nv"))
    inner = counts.join(size, ["attribute", "value"]).groupBy("attribute", "value").agg(F.max("nv").alias("nv"), F.sum(plogp(F.col("n"), F.col("nv"))).alias("h"))
    mean = inner.groupBy("attribute").agg((F.sum(F.col("nv") * F.col("h")) / F.sum("nv")).alias("mean"), F.sum(F.col("nv") + 1).alias("s"))
    split = size.join(mean.select("attribute", "s"), "attribute").groupBy("attribute").agg(F.sum(plogp(F.col("nv") + 1, F.col("s"))).alias("split_info"))
    out = root.join(mean, "attribute").join(split, "attribute").withColumn("information_gain", F.col("root") - F.col("mean"))
    return out.select("attribute", "information_gain", "split_info", F.when(F.col("split_info") > 0, F.col("information_gain") / F.col("split_info")).alias("gain_ratio"))


def bayes_scores(train: DataFrame, test: DataFrame, attributes: list[str], label: str, key: str) -> DataFrame:
    """(key, label, score): log prior and log likelihoods, every count half a unit up; bins are the values seen and one more."""
    counts = value_counts(train, attributes, label)
    n = train.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("nl"))
    total = n.agg(F.sum("nl").alias("t"), F.count("*").alias("k"))
    bins = counts.groupBy("attribute").agg((F.countDistinct("value") + 1).alias("b"))
    prior = n.crossJoin(F.broadcast(total)).select("label", "nl", F.log((F.col("nl") + 0.5) / (F.col("t") + 0.5 * F.col("k"))).alias("prior"))
    rows = test.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("?")).alias("value")) for a in attributes])).alias("p")).select(key, "p.attribute", "p.value")
    each = rows.join(bins, "attribute").crossJoin(F.broadcast(prior))  # labels are few
    each = each.join(counts, ["attribute", "value", "label"], "left")
    like = F.log((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("nl") + 0.5 * F.col("b")))
    return each.groupBy(key, "label").agg((F.max("prior") + F.sum(like)).alias("score"))


def gaussian_bayes(train: DataFrame, test: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """test with predicted: the label of the largest prior times densities, the last by name of equal ones.

    A prior is (n + 1) / (N + K). A density divides by the root of 2 pi sd, not of
    its square, as the production classifier does; where sd is zero it is one at the mean and
    zero elsewhere. A null attribute counts for no label. The model is one row, an entry a
    label, that a scalar subquery hands to the rows: train is read once and nothing is shuffled but its sums.
    """
    stats = [F.struct(F.avg(a).alias("mean"), F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("sd")).alias(a) for a in attributes]
    model = train.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *stats)
    total = F.aggregate("model", F.lit(0).cast("long"), lambda t, m: t + m["n"]) + F.size("model")

    def log_density(x, m):
        bell = -F.log(2 * math.pi * m["sd"]) / 2 - (x - m["mean"]) * (x - m["mean"]) / (2 * m["sd"] * m["sd"])
        point = F.when(x == m["mean"], 0.0).otherwise(float("-inf"))
        return F.coalesce(F.when(m["sd"] > 0, bell).otherwise(point), F.lit(0.0))

    def scored(m):
        score = F.log((m["n"] + 1) / total)
        for a in attributes:
            score = score + F.when(F.col(a).isNotNull(), log_density(F.col(a), m[a])).otherwise(0.0)
        return F.struct(score.alias("score"), m["label"].alias("label"))

    rows = test.withColumn("model", model.agg(F.collect_list(F.struct("label", "n", *attributes))).scalar())
    return rows.withColumn("predicted", F.array_max(F.transform("model", scored))["label"]).drop("model")


def best_label(scores: DataFrame, key: str) -> DataFrame:
    """The best label of each key; the first by name where scores agree to 9 decimals."""
    top = F.max_by("label", F.struct(F.round("score", 9), F.expr("transform(split(label, ''), x -> -ascii(x))")))
    return scores.groupBy(key).agg(top.alias("predicted"))


def equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """df with bin, 0 to bins - 1, over the column's whole range."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.floor((F.col(column) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))
    return df.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1)).cast("long")).drop("lo", "hi")


def equal_frequency_cuts(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(i, cut): the column's quantiles that part it into bins; ranks come from counts per value, so no row is sorted in one task."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = ranked(counts, "v", weight="n").withColumn("upto", F.col("rank") + F.col("n"))
    total = counts.agg(F.sum("n").alias("t"))
    want = total.select("t", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("i"))
    j = upto.crossJoin(F.broadcast(want)).filter(F.col("upto") * bins >= F.col("i") * F.col("t"))
    return j.groupBy("i").agg(F.min("v").alias("cut"))


def ranked(df: DataFrame, *order: str, weight: str | None = None) -> DataFrame:
    """df with rank: how many rows (or how much weight) come before a row in this order.

    Rows are dealt by ranges and stored; each range is ranked in a task of its own, and
    starts where the ranges before it end. Only a row per range meets in one task.
    """
    size = F.col(weight) if weight else F.lit(1)
    dealt = stored(df.withColumn("_size", size.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum("_size").alias("_n"))
    first = totals.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range", "_first")
    own = F.coalesce(F.sum("_size").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(first), "_range").withColumn("rank", own + F.col("_first")).drop("_size", "_range", "_first")


def folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Stratified folds: rows in order of label, then key, take turns over the whole set."""
    return ranked(df, label, key).withColumn("fold", F.col("rank") % k).drop("rank")


def boosting_scores(features: DataFrame, stumps: DataFrame, key: str) -> DataFrame:
    """(key, score, posterior): the sum of alpha x (c1 if the stump's token is there, else c0), over the alphas' sum. stumps: a small model table."""
    n = stumps.agg(F.sum("alpha").alias("a"), F.sum(F.col("alpha") * F.col("c0")).alias("base"), F.count("*").alias("rounds"))
    hit = features.select(key, "token").distinct().join(F.broadcast(stumps), "token").groupBy(key).agg(F.sum(F.col("alpha") * (F.col("c1") - F.col("c0"))).alias("d"))
    raw = features.select(key).distinct().join(hit, key, "left").crossJoin(F.broadcast(n))
    s = (F.col("base") + F.coalesce("d", F.lit(0.0))) / F.col("a")
    return raw.select(key, s.alias("score"), (1 / (1 + F.exp(-2 * s * F.col("rounds")))).alias("posterior"))


def backoff_tags(tagged: DataFrame, words: DataFrame, default: str, suffix: int = 3) -> DataFrame:
    """words(word) with tag: the word's commonest tag, else its ending's, else the default; ties go to the first tag by name. tagged(word, tag, n): counts."""
    ending = lambda c: F.substring(c, -suffix, suffix)

    def best(key, name):
        c = tagged.groupBy(key.alias("k"), "tag").agg(F.sum("n").alias("n"))
        return c.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("m"), "tag")).alias("b")).select("k", F.col("b.tag").alias(name))

    x = words.join(best(F.col("word"), "own").withColumnRenamed("k", "word"), "word", "left").withColumn("k", ending(F.col("word")))
    return x.join(best(ending(F.col("word")), "like"), "k", "left").drop("k").withColumn("tag", F.coalesce("own", "like", F.lit(default))).withColumn("source", F.when(F.col("own").isNotNull(), "word").when(F.col("like").isNotNull(), "ending").otherwise("default")).drop("own", "like")


def split_by_id(df: DataFrame, key: str) -> DataFrame:
    """df with part: a tenth of the ids test, a tenth dev, the rest train."""
    return df.withColumn("part", F.when(F.pmod(key, F.lit(10)) == 0, "test").when(F.pmod(key, F.lit(10)) == 1, "dev").otherwise("train"))

"""Distributions beyond counts: log domain, sampling, cross validation, divergences in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.operators import statistics as S


def add_logs(a: Column, b: Column) -> Column:
    """log2(2**a + 2**b) without leaving the log domain."""
    top = F.greatest(a, b)
    return top + F.log2(F.pow(F.lit(2.0), a - top) + F.pow(F.lit(2.0), b - top))


def sum_logs(df: DataFrame, by: str, log: str) -> DataFrame:
    """(by, total): the log2 of the sum of 2**log, scaled by each group's largest."""
    top = df.groupBy(by).agg(F.max(log).alias("top"))
    return df.join(top, by).groupBy(by).agg((F.max("top") + F.log2(F.sum(F.pow(F.lit(2.0), F.col(log) - F.col("top"))))).alias("total"))


def log_domain(p: DataFrame, floor: float = 1e-13) -> DataFrame:
    """p(…, p) with logp, zero probabilities taken as floor."""
    return p.withColumn("logp", F.log2(F.when(F.col("p") > 0, F.col("p")).otherwise(F.lit(floor))))


def symmetric_kl(p: DataFrame, q: DataFrame, by: str, sample: str) -> DataFrame:
    """(by, kl): the divergences both ways, added."""
    a, b = S.kl_divergence(p, q, by, sample), S.kl_divergence(q, p, by, sample)
    return a.unionByName(b).groupBy(by).agg(F.sum("kl").alias("kl"), F.count("*").alias("ways")).filter("ways = 2").drop("ways")


def argmin(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Rows with the smallest value of their group, ties included."""
    low = df.groupBy(by).agg(F.min(value).alias("_low"))
    return df.join(low, by).filter(F.col(value) == F.col("_low")).select(by, key, value)


def sampled(p: DataFrame, by: str, sample: str, draws: list[float]) -> DataFrame:
    """(by, u, sample): for each draw u in [0, 1) the sample, in order of its name, in whose stretch of the cumulated probabilities it falls. p(by, sample, c)."""
    w = W.partitionBy(by).orderBy(sample)
    total = F.sum("c").over(W.partitionBy(by))
    cum = p.withColumn("hi", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0)) / total).withColumn("lo", F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) / total)
    u = F.explode(F.array(*map(F.lit, draws)))
    return cum.withColumn("u", u).filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(by, "u", sample)


def uniform(counts: DataFrame, by: str, sample: str) -> DataFrame:
    """(by, sample, p): every sample seen is equally likely."""
    n = counts.groupBy(by).agg(F.count("*").alias("b"))
    return counts.join(n, by).select(by, sample, (F.lit(1.0) / F.col("b")).alias("p"))


def cross_validated(halves: DataFrame, sample: str) -> DataFrame:
    """(r, p): the mean, over both halves' held-out estimates, of the probability of a sample seen r times. halves(sample, a, b): counts in each half."""
    both = halves.select(F.col("a").alias("r"), F.col("b").alias("o"), F.lit(0).alias("way")).unionAll(halves.select("b", "a", F.lit(1)))
    total = both.groupBy("way").agg(F.sum("o").alias("n"))
    each = both.filter("r > 0").groupBy("way", "r").agg(F.count("*").alias("nr"), F.sum("o").alias("o")).join(F.broadcast(total), "way")  # two rows
    return each.groupBy("r").agg((F.sum(F.col("o") / (F.col("nr") * F.col("n"))) / 2).alias("p"))


def flattened(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Two-level keys as one, with a point between."""
    return df.withColumn("key", F.concat_ws(".", outer, inner)).drop(outer, inner)


def symmetric_closure(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select("b", "a")).distinct()


def minimal_sets(df: DataFrame, context: str, target: str) -> DataFrame:
    """(context, targets): contexts that occur with two targets or more."""
    return df.groupBy(context).agg(F.array_sort(F.collect_set(target)).alias("targets")).filter(F.size("targets") > 1)

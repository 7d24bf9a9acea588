"""Frequency distributions, smoothing, entropy, divergences and evaluation metrics over count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.sources.scratch import stored


def freq_dist(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("c"))


def _totals(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("b"))


def smoothed(counts: DataFrame, by: tuple[str, ...], method: str, bins: int | None = None, gamma: float = 0.5) -> DataFrame:
    """counts(by, sample, c) with p under mle, lidstone, laplace, ele or witten_bell; bins defaults to the samples seen plus one."""
    counts = stored(counts, "counts")  # for the totals and the shares
    t = counts.join(F.broadcast(_totals(counts, by)) if not by else _totals(counts, by), list(by)) if by else counts.crossJoin(F.broadcast(_totals(counts, by)))
    size = F.lit(bins) if bins else F.col("b") + 1
    g = {"lidstone": gamma, "laplace": 1.0, "ele": 0.5}.get(method)
    p = F.col("c") / F.col("n") if method == "mle" else F.col("c") / (F.col("n") + F.col("b")) if method == "witten_bell" else (F.col("c") + g) / (F.col("n") + size * g)
    return t.withColumn("p", p).drop("n", "b")


def good_turing(counts: DataFrame) -> DataFrame:
    """(r, n_r, p): the estimate (r + 1) N(r+1) / (N(r) N) of a sample seen r times; 0 where nothing was seen r + 1 times."""
    nr = counts.groupBy(F.col("c").alias("r")).agg(F.count("*").alias("n_r"))
    up = nr.select((F.col("r") - 1).alias("r"), F.col("n_r").alias("n_up"))
    total = nr.agg(F.sum(F.col("r") * F.col("n_r")).alias("n"))
    return nr.join(up, "r", "left").crossJoin(F.broadcast(total)).select("r", "n_r", ((F.col("r") + 1) * F.coalesce("n_up", F.lit(0)) / (F.col("n_r") * F.col("n"))).alias("p"))


def entropy(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, entropy) in bits, and signed_entropy, its negative."""
    p = smoothed(counts, by, "mle")
    h = F.sum(-F.col("p") * F.log2("p"))
    return p.groupBy(*by).agg(h.alias("entropy")).withColumn("signed_entropy", -F.col("entropy"))


def merged(a: Column, b: Column) -> Column:
    """Two maps of counts as one: counts of a key in both are added; a null map is an empty one."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def kl_divergence(p: DataFrame, q: DataFrame, by: str, sample: str, floor: float = 1e-13) -> DataFrame:
    """(by, kl): sum of p log2(p / q), a missing q taken as floor."""
    j = p.select(by, sample, F.col("p").alias("x")).join(q.select(by, sample, F.col("p").alias("y")), [by, sample], "left")
    return j.groupBy(by).agg(F.sum(F.col("x") * F.log2(F.col("x") / F.coalesce("y", F.lit(floor)))).alias("kl"))


def euclidean(p: DataFrame, q: DataFrame, by: str, sample: str) -> DataFrame:
    """(by, distance) over the samples of p only."""
    j = p.select(by, sample, F.col("p").alias("x")).join(q.select(by, sample, F.col("p").alias("y")), [by, sample], "left")
    return j.groupBy(by).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.coalesce("y", F.lit(0.0)), F.lit(2)))).alias("distance"))


def argmax(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Rows with the largest value of their group, ties included; the maximum is combined before the shuffle."""
    top = df.groupBy(by).agg(F.max(value).alias("_top"))
    return df.join(top, by).filter(F.col(value) == F.col("_top")).select(by, key, value)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """One-against-the-rest metrics per class from confusion cells; null where a denominator is zero."""
    r = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("row"))
    c = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("col"))
    d = cells.filter("truth = predicted").select(F.col("truth").alias("class"), F.col("n").alias("tp"))
    j = r.join(c, "class", "full").join(d, "class", "left").na.fill(0).crossJoin(F.broadcast(cells.agg(F.sum("n").alias("total"))))
    ratio = lambda a, b: F.when(b != 0, a / b)
    j = j.withColumn("precision", ratio(F.col("tp"), F.col("col"))).withColumn("recall", ratio(F.col("tp"), F.col("row")))
    return j.select("class", "tp", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), ((F.col("total") - F.col("row") - F.col("col") + 2 * F.col("tp")) / F.col("total")).alias("accuracy"))


def window_diff(a: Column, b: Column, k: int) -> Column:
    """Sum of the differing numbers of boundaries in windows of k, of two strings of 0 and 1."""
    ones = lambda s, i: F.length(F.regexp_replace(F.substring(s, i, F.lit(k)), "0", ""))
    i = F.sequence(F.lit(1), F.length(a) - k + 1)
    return F.when(F.length(a) >= k, F.aggregate(i, F.lit(0), lambda t, x: t + F.abs(ones(a, x) - ones(b, x)))).otherwise(F.lit(0))


def set_scores(truth: DataFrame, test: DataFrame, by: str, item: str) -> DataFrame:
    """(by, precision, recall, f): of the set of items found; null where undefined."""
    a, b = truth.select(by, item).distinct().withColumn("t", F.lit(1)), test.select(by, item).distinct().withColumn("s", F.lit(1))
    s = a.join(b, [by, item], "full").groupBy(by).agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum(F.col("t") * F.col("s")).alias("both"))
    p, r = F.coalesce("both", F.lit(0)) / F.col("s"), F.coalesce("both", F.lit(0)) / F.col("t")
    return s.select(by, p.alias("precision"), r.alias("recall")).withColumn("f", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))

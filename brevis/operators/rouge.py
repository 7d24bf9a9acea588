"""ROUGE-N and ROUGE-SU over peer and model texts, as joins of gram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.functions import text as T


def rouge_tokens(s: Column, limit: int | None = 100) -> Column:
    """Lower-cased tokens that start with a letter, a digit or $, of the first `limit` words."""
    words = F.filter(F.split(s, "\\s+"), lambda w: w != "")
    if limit:
        words = F.slice(words, 1, F.lit(limit))
    flat = F.regexp_replace(F.replace(F.lower(F.array_join(words, " ")), F.lit("-"), F.lit(" - ")), "[^a-z0-9$ -]", " ")
    return F.filter(F.split(flat, " +"), lambda w: w.rlike("^[a-z0-9$]"))


def grams(tokens: Column, metric: str) -> Column:
    """R1..R4: n-grams. SU4: pairs with at most four words between them, and all single words but the last."""
    if metric != "SU4":
        return T.ngrams(tokens, int(metric[1:]))
    pairs = F.flatten(F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + 2, F.lit(5)), lambda y: F.concat_ws("_", x, y))))
    return F.concat(pairs, F.when(F.size(tokens) > 1, F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(F.array().cast("array<string>")))


def _counts(texts: DataFrame, keys: list[str], metric: str, limit: int | None) -> DataFrame:
    toks = texts.withColumn("toks", rouge_tokens(F.col("text"), limit))
    return toks.select(*keys, F.explode(grams(F.col("toks"), metric)).alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def rouge(peers: DataFrame, models: DataFrame, metric: str, limit: int | None = 100, alpha: float = 0.5) -> DataFrame:
    """(topic_id, peer_id, recall, precision, f) of peers(topic_id, peer_id, text) against models(topic_id, annotator, text), pooled over the models.

    Counts are clipped per model; a peer is counted against each model.
    """
    p = _counts(peers, ["topic_id", "peer_id"], metric, limit)
    m = _counts(models, ["topic_id", "annotator"], metric, limit)
    hits = p.join(m.withColumnRenamed("n", "mn"), ["topic_id", "gram"]).groupBy("topic_id", "peer_id").agg(F.sum(F.least("n", "mn")).alias("hits"))
    model = m.groupBy("topic_id").agg(F.sum("n").alias("model"))
    size = models.groupBy("topic_id").agg(F.countDistinct("annotator").alias("models"))
    peer = p.groupBy("topic_id", "peer_id").agg(F.sum("n").alias("peer"))
    all_ = peers.select("topic_id", "peer_id").distinct().join(size, "topic_id").join(model, "topic_id", "left").join(peer, ["topic_id", "peer_id"], "left").join(hits, ["topic_id", "peer_id"], "left").na.fill(0, ["model", "peer", "hits"])
    r = F.when(F.col("model") > 0, F.col("hits") / F.col("model")).otherwise(F.lit(0.0))
    q = F.when(F.col("peer") > 0, F.col("hits") / (F.col("peer") * F.col("models"))).otherwise(F.lit(0.0))
    out = all_.select("topic_id", "peer_id", r.alias("recall"), q.alias("precision"))
    bottom = (1 - alpha) * F.col("recall") + alpha * F.col("precision")
    return out.withColumn("f", F.when(bottom > 0, F.col("recall") * F.col("precision") / bottom).otherwise(F.lit(0.0)))


def jackknife(models: DataFrame, metric: str, limit: int | None = 100) -> DataFrame:
    """Each model as a peer against the other models of its topic: (topic_id, peer_id, recall), the mean over topics with two models or more."""
    m = _counts(models, ["topic_id", "annotator"], metric, limit)
    total = m.groupBy("topic_id", "annotator").agg(F.sum("n").alias("total"))
    a, b = m.select("topic_id", "gram", F.col("annotator").alias("peer_id"), F.col("n").alias("pn")), m
    hits = a.join(b, ["topic_id", "gram"]).filter("peer_id <> annotator").groupBy("topic_id", "peer_id").agg(F.sum(F.least("pn", "n")).alias("hits"))
    all_ = total.groupBy("topic_id").agg(F.sum("total").alias("pool"), F.count("*").alias("k")).filter("k > 1")
    j = total.withColumnRenamed("annotator", "peer_id").join(all_, "topic_id").join(hits, ["topic_id", "peer_id"], "left")
    bottom = F.col("pool") - F.col("total")
    return j.select("topic_id", "peer_id", F.when(bottom > 0, F.coalesce("hits", F.lit(0)) / bottom).otherwise(F.lit(0.0)).alias("recall"))


def bootstrap(scores: DataFrame, by: str, value: str, samples: int = 1000, seed: int = 7) -> DataFrame:
    """(by, mean, low, high): 95 % interval of the mean over resampled rows.

    Poisson resampling: each row draws a count per sample from its own hash, so that
    the sums are one aggregation and no group is gathered.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in scores.columns], "b"), F.lit(1 << 30)) / float(1 << 30)
    cut, cum, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        cum += p
        cut.append(cum)
        p /= k + 1
    draws = sum((F.when(u >= c, 1).otherwise(0) for c in cut), F.lit(0))
    rows = scores.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("k", draws)
    means = rows.groupBy(by, "b").agg((F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("m")).filter("m is not null")
    ends = means.groupBy(by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return scores.groupBy(by).agg(F.avg(value).alias("mean")).join(ends, by)

"""Frequency distributions, smoothing, divergences, metrics and ROUGE."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.operators import rouge as R
from brevis.operators import statistics as S
from brevis.sources.tables import sentences, table, topic_sentences, topics

from .registry import SENTS, grams, query, words_of


def _words(spark, d):
    return topic_sentences(spark, d).select("topic_id", "doc_id", F.explode("tok").alias("word"))


_W = f"{SENTS}, w AS (SELECT topic_id, docset, doc_id, unnest(tok) AS word FROM sent)"
_FREQ = f"{_W}, c AS (SELECT topic_id, word, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT topic_id, sum(c) AS n, count(*) AS b FROM c GROUP BY 1)"


@query(f"WITH {_W}, c AS (SELECT word, count(*) AS c FROM w GROUP BY 1) SELECT word, c, round(c / sum(c) OVER (), 12) AS freq FROM c")
def freqdist_words(spark, d):
    c = S.freq_dist(_words(spark, d), "word")
    return S.smoothed(c, (), "mle").select("word", "c", F.round("p", 12).alias("freq"))


@query("WITH w AS (SELECT lang, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS c FROM w WHERE word <> '' GROUP BY ALL) SELECT lang, word, c, round(c / sum(c) OVER (PARTITION BY lang), 12) AS p FROM c")
def cond_freqdist_lang_word(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), "[ \\t\\n\\x0B\\f\\r]+")).alias("word")).filter("word <> ''")
    return S.smoothed(S.freq_dist(w, "lang", "word"), ("lang",), "mle").select("lang", "word", "c", F.round("p", 12).alias("p"))


def _smooth(method: str, formula: str):
    def f(spark, d):
        return S.smoothed(S.freq_dist(_words(spark, d), "topic_id", "word"), ("topic_id",), method).select("topic_id", "word", F.round("p", 12).alias("p"))

    f.__name__ = f"smooth_{method}"
    query(f"WITH {_FREQ} SELECT topic_id, word, round({formula}, 12) AS p FROM c JOIN n USING (topic_id)")(f)


for _m, _f in (("mle", "c / n"), ("lidstone", "(c + 0.5) / (n + (b + 1) * 0.5)"), ("laplace", "(c + 1) / (n + b + 1)"), ("ele", "(c + 0.5) / (n + (b + 1) * 0.5)"), ("witten_bell", "c / (n + b)")):
    _smooth(_m, _f)


@query(f"WITH {_W}, c AS (SELECT word, count(*) AS c FROM w GROUP BY 1), r AS (SELECT c AS r, count(*) AS n_r FROM c GROUP BY 1), n AS (SELECT sum(r * n_r) AS n FROM r) SELECT a.r, a.n_r, round((a.r + 1) * coalesce(b.n_r, 0) / (a.n_r * n.n), 12) AS p FROM r a LEFT JOIN r b ON b.r = a.r + 1, n")
def good_turing(spark, d):
    return S.good_turing(S.freq_dist(_words(spark, d), "word")).withColumn("p", F.round("p", 12))


@query(f"WITH {_W}, h AS (SELECT doc_id % 2 AS half, word FROM w), c AS (SELECT word, count(CASE WHEN half = 0 THEN 1 END) AS r, count(CASE WHEN half = 1 THEN 1 END) AS o FROM h GROUP BY word), n AS (SELECT sum(o) AS n FROM c) SELECT r, count(*) AS n_r, round(sum(o) / (count(*) * max(n.n)), 12) AS p FROM c, n WHERE r > 0 GROUP BY r")
def heldout_estimate(spark, d):
    """Held-out estimate by count: the mean share, among the held-out half, of words seen r times in the other."""
    half = F.col("doc_id") % 2
    c = _words(spark, d).groupBy("word").agg(F.count_if(half == 0).alias("r"), F.count_if(half == 1).alias("o"))
    n = c.agg(F.sum("o").alias("n"))
    return c.filter("r > 0").groupBy("r").agg(F.count("*").alias("n_r"), F.sum("o").alias("o")).crossJoin(F.broadcast(n)).select("r", "n_r", F.round(F.col("o") / (F.col("n_r") * F.col("n")), 12).alias("p"))


@query(f"WITH {_FREQ} SELECT topic_id, round(sum(-(c / n) * log2(c / n)), 9) AS entropy, round(sum((c / n) * log2(c / n)), 9) AS signed_entropy FROM c JOIN n USING (topic_id) GROUP BY topic_id")
def entropy_by_topic(spark, d):
    e = S.entropy(S.freq_dist(_words(spark, d), "topic_id", "word"), ("topic_id",))
    return e.select("topic_id", F.round("entropy", 9).alias("entropy"), F.round("signed_entropy", 9).alias("signed_entropy"))


_AB = f"{_W}, s AS (SELECT split_part(topic_id, '-', 1) AS source, docset, word FROM w), c AS (SELECT source, docset, word, count(*) AS c FROM s GROUP BY ALL), p AS (SELECT source, docset, word, c / sum(c) OVER (PARTITION BY source, docset) AS p FROM c), a AS (SELECT * FROM p WHERE docset = 'A'), b AS (SELECT * FROM p WHERE docset = 'B')"


def _halves(spark, d):
    w = _words(spark, d).select(F.split_part("topic_id", F.lit("-"), F.lit(1)).alias("source"), F.split_part("topic_id", F.lit("-"), F.lit(2)).alias("docset"), "word")
    p = S.smoothed(S.freq_dist(w, "source", "docset", "word"), ("source", "docset"), "mle")
    return p.filter("docset = 'A'"), p.filter("docset = 'B'")


@query(f"WITH {_AB} SELECT a.source, round(sum(a.p * log2(a.p / coalesce(b.p, 1e-13))), 6) AS kl FROM a LEFT JOIN b ON a.source = b.source AND a.word = b.word GROUP BY a.source")
def kl_docset_a_b(spark, d):
    a, b = _halves(spark, d)
    return S.kl_divergence(a, b, "source", "word").withColumn("kl", F.round("kl", 6))


@query(f"WITH {_AB} SELECT a.source, round(sqrt(sum(power(a.p - coalesce(b.p, 0), 2))), 9) AS distance FROM a LEFT JOIN b ON a.source = b.source AND a.word = b.word GROUP BY a.source")
def euclidean_freq(spark, d):
    a, b = _halves(spark, d)
    return S.euclidean(a, b, "source", "word").withColumn("distance", F.round("distance", 9))


@query(f"WITH {_FREQ}, m AS (SELECT topic_id, max(c) AS top FROM c GROUP BY 1) SELECT topic_id, word, c FROM c JOIN m USING (topic_id) WHERE c = top")
def argmax_word(spark, d):
    return S.argmax(S.freq_dist(_words(spark, d), "topic_id", "word"), "topic_id", "word", "c")


_PRED = "p AS (SELECT l.doc_id, l.quality::VARCHAR AS truth, CASE WHEN d.n_chars >= 1000 THEN '1' ELSE '0' END AS predicted FROM labels l JOIN documents d USING (doc_id)), cells AS (SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL)"


def _cells(spark, d):
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.confusion(p.withColumn("guess", F.when(F.col("n_chars") >= 1000, "1").otherwise("0")), "quality", "guess")


@query(f"WITH {_PRED} SELECT truth, predicted, n FROM cells")
def confusion_matrix(spark, d):
    return _cells(spark, d)


@query(f"""WITH {_PRED}, k AS (SELECT truth AS class FROM cells UNION SELECT predicted FROM cells), m AS (SELECT class, coalesce(sum(CASE WHEN truth = class THEN n END), 0) AS r, coalesce(sum(CASE WHEN predicted = class THEN n END), 0) AS c, coalesce(sum(CASE WHEN truth = class AND predicted = class THEN n END), 0) AS tp, sum(n) AS total FROM k, cells GROUP BY class)
SELECT class, tp::BIGINT AS tp, round(tp / nullif(c, 0), 9) AS precision, round(tp / nullif(r, 0), 9) AS recall, round(2 * (tp / nullif(c, 0)) * (tp / nullif(r, 0)) / nullif(tp / nullif(c, 0) + tp / nullif(r, 0), 0), 9) AS f1, round((total - r - c + 2 * tp) / total, 9) AS accuracy FROM m""")
def precision_recall_f(spark, d):
    m = S.class_metrics(_cells(spark, d))
    return m.select("class", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"WITH {SENTS}, a AS (SELECT DISTINCT topic_id, unnest({grams('tok', 1)}) AS w FROM sent WHERE ord = 0), b AS (SELECT DISTINCT topic_id, unnest({grams('tok', 1)}) AS w FROM sent WHERE ord = 1), k AS (SELECT topic_id, count(DISTINCT a.w) AS t, count(DISTINCT b.w) AS s, count(DISTINCT CASE WHEN a.w IS NOT NULL AND b.w IS NOT NULL THEN w END) AS hit FROM (SELECT topic_id, w FROM a UNION SELECT topic_id, w FROM b) u LEFT JOIN a USING (topic_id, w) LEFT JOIN b USING (topic_id, w) GROUP BY topic_id) SELECT topic_id, round(hit / nullif(s, 0), 9) AS precision, round(hit / nullif(t, 0), 9) AS recall FROM k")
def set_precision_recall(spark, d):
    s = topic_sentences(spark, d).select("topic_id", "ord", F.explode("tok").alias("w"))
    x = S.set_scores(s.filter("ord = 0"), s.filter("ord = 1"), "topic_id", "w")
    return x.select("topic_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_BITS = "array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '[.!?]$') THEN '1' ELSE '0' END), '')"
_LONG = "array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN strlen(w) >= 10 THEN '1' ELSE '0' END), '')"


@query(f"WITH s AS (SELECT item_id, {_BITS} AS a, {_LONG} AS b FROM benchmark) SELECT item_id, coalesce(list_sum(list_transform(range(1, len(a) - 3 + 2), lambda i: abs(len(replace(a[i:i + 2], '0', '')) - len(replace(b[i:i + 2], '0', ''))))), 0)::BIGINT AS diff FROM s")
def windowdiff_flags(spark, d):
    w = F.split("text", " ")
    a = F.array_join(F.transform(w, lambda x: F.when(x.rlike("[.!?]$"), "1").otherwise("0")), "")
    b = F.array_join(F.transform(w, lambda x: F.when(F.octet_length(x) >= 10, "1").otherwise("0")), "")
    s = table(spark, d, "benchmark").select("item_id", a.alias("a"), b.alias("b"))
    return s.select("item_id", S.window_diff(F.col("a"), F.col("b"), 3).cast("long").alias("diff"))


def _peers(spark, d):
    c = table(spark, d, "conversations")
    topic = F.concat(F.lit("t"), F.col("conv_id") % 40).alias("topic_id")
    models = c.filter("role = 'assistant'").select(topic, F.concat_ws("-", "conv_id", "turn").alias("annotator"), "text")
    peers = table(spark, d, "benchmark").select(F.concat(F.lit("t"), F.col("item_id")).alias("topic_id"), F.concat(F.lit("b"), F.col("item_id")).alias("peer_id"), "text")
    return peers, models


_RT = "list_filter(regexp_split_to_array(regexp_replace(replace(lower(array_to_string({w}[1:100], ' ')), '-', ' - '), '[^a-z0-9$ -]', ' ', 'g'), ' +'), lambda w: regexp_matches(w, '^[a-z0-9$]'))"
_RG = {"1": grams("tk", 1), "2": grams("tk", 2), "3": grams("tk", 3), "4": grams("tk", 4), "SU4": "list_concat(flatten(list_transform(range(1, len(tk) + 1), lambda i: list_transform(tk[i + 1:i + 5], lambda y: tk[i] || '_' || y))), tk[1:greatest(len(tk) - 1, 0)])"}


def _rouge_cte(metric: str) -> str:
    t = _RT.format(w=words_of("text"))
    return f"""mt AS (SELECT 't' || (conv_id % 40) AS topic_id, conv_id || '-' || turn AS annotator, {t} AS tk FROM conversations WHERE role = 'assistant'), pt AS (SELECT 't' || item_id AS topic_id, 'b' || item_id AS peer_id, {t} AS tk FROM benchmark),
m AS (SELECT topic_id, annotator, gram, count(*) AS n FROM (SELECT topic_id, annotator, unnest({_RG[metric]}) AS gram FROM mt) GROUP BY ALL), p AS (SELECT topic_id, peer_id, gram, count(*) AS n FROM (SELECT topic_id, peer_id, unnest({_RG[metric]}) AS gram FROM pt) GROUP BY ALL)"""


def _rouge(metric: str):
    def f(spark, d):
        return R.rouge(*_peers(spark, d), metric if metric == "SU4" else f"R{metric}").select("topic_id", "peer_id", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f")])

    f.__name__ = f"rouge_{metric.lower()}"
    query(f"""WITH {_rouge_cte(metric)}, k AS (SELECT topic_id, count(DISTINCT annotator) AS models FROM mt GROUP BY 1), a AS (SELECT pt.topic_id, pt.peer_id, k.models, coalesce((SELECT sum(n) FROM m WHERE m.topic_id = pt.topic_id), 0) AS model, coalesce((SELECT sum(n) FROM p WHERE p.peer_id = pt.peer_id), 0) AS peer, coalesce((SELECT sum(least(p.n, m.n)) FROM p JOIN m ON p.topic_id = m.topic_id AND p.gram = m.gram WHERE p.peer_id = pt.peer_id), 0) AS hits FROM pt JOIN k USING (topic_id)),
r AS (SELECT topic_id, peer_id, coalesce(hits / nullif(model, 0), 0) AS rec, coalesce(hits / nullif(peer * models, 0), 0) AS pre FROM a) SELECT topic_id, peer_id, round(rec, 9) AS recall, round(pre, 9) AS precision, round(coalesce(rec * pre / nullif(0.5 * rec + 0.5 * pre, 0), 0), 9) AS f FROM r""")(f)


for _m in _RG:
    _rouge(_m)


@query(f"WITH {_rouge_cte('2')}, tot AS (SELECT topic_id, annotator AS peer_id, sum(n) AS total FROM m GROUP BY ALL), pool AS (SELECT topic_id, sum(total) AS pool, count(*) AS k FROM tot GROUP BY 1), hits AS (SELECT a.topic_id, a.annotator AS peer_id, sum(least(a.n, b.n)) AS hits FROM m a JOIN m b ON a.topic_id = b.topic_id AND a.gram = b.gram AND a.annotator <> b.annotator GROUP BY ALL) SELECT topic_id, peer_id, round(coalesce(coalesce(hits, 0) / nullif(pool - total, 0), 0), 9) AS recall FROM tot JOIN pool USING (topic_id) LEFT JOIN hits USING (topic_id, peer_id) WHERE k > 1")
def rouge_jackknife(spark, d):
    return R.jackknife(_peers(spark, d)[1], "R2").withColumn("recall", F.round("recall", 9))


@query(None)
def rouge_bootstrap(spark, d):
    scores = R.rouge(*_peers(spark, d), "R1").select(F.lit("R1").alias("metric"), "topic_id", "recall")
    return R.bootstrap(scores, "metric", "recall", samples=200)


@query("SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def mean_by_set_grouping(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "n_chars")
    g = docs.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "mean")


@query("SELECT source, count(CASE WHEN lang = 'de' THEN 1 END) AS de, count(CASE WHEN lang = 'en' THEN 1 END) AS en, count(CASE WHEN lang = 'es' THEN 1 END) AS es, count(CASE WHEN lang = 'fr' THEN 1 END) AS fr FROM documents GROUP BY source")
def score_pivot(spark, d):
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(var_samp(l_quantity), 0), 6) AS variance, round(coalesce(stddev_samp(l_quantity), 0), 6) AS deviation FROM lineitem GROUP BY ALL")
def stat_list(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.coalesce(F.var_samp("l_quantity"), F.lit(0.0)), 6).alias("variance"), F.round(F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)), 6).alias("deviation"))


@query("WITH RECURSIVE p AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey < 24), c AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a) SELECT a, b FROM c")
def transitive_closure(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey % 5 <> 4 and n_nationkey < 24").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"))
    return closure(n)


def closure(pairs):
    """Transitive closure of (a, b) without cycles, by a recursive query."""
    spark, now = pairs.sparkSession, pairs.distinct()
    name = f"closure_{id(pairs)}"
    now.createOrReplaceTempView(name)
    return spark.sql(f"WITH RECURSIVE c(a, b) AS (SELECT a, b FROM {name} UNION ALL SELECT c.a, p.b FROM c JOIN {name} p ON c.b = p.a) SELECT DISTINCT a, b FROM c")


@query("SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY 1")
def paradigm_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])


@query("WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT coalesce(prev, '<s>') AS prev, event_type, count(*) AS n FROM s GROUP BY ALL")
def sequence_lag_features(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").withColumn("prev", F.coalesce(F.lag("event_type").over(w), F.lit("<s>")))
    return s.groupBy("prev", "event_type").agg(F.count("*").alias("n"))

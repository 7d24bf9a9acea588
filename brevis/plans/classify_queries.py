"""Classification, attribute measures, discretisation, tagging, splitting and clustering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.stem import stem_table
from brevis.operators import learning as L
from brevis.operators import splitter as SB
from brevis.sources.tables import sentences, table, topic_sentences, topics

from .registry import SENTS, query

ATTRIBUTES = ["source", "lang", "size_class"]
_ROWS = "r AS (SELECT l.doc_id, l.quality::VARCHAR AS label, d.source, d.lang, (least(length(n_chars::VARCHAR), 5))::VARCHAR AS size_class FROM labels l JOIN documents d USING (doc_id))"
_LONG = f"{_ROWS}, lf AS (SELECT doc_id, label, 'source' AS attribute, source AS value FROM r UNION ALL SELECT doc_id, label, 'lang', lang FROM r UNION ALL SELECT doc_id, label, 'size_class', size_class FROM r), cnt AS (SELECT attribute, value, label, count(*) AS n FROM lf GROUP BY ALL)"


def _rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.least(F.length(F.col("n_chars").cast("string")), F.lit(5)).cast("string").alias("size_class"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label")).join(docs, "doc_id")


@query(f"WITH {_LONG} SELECT * FROM cnt")
def nb_counts(spark, d):
    return L.value_counts(_rows(spark, d), ATTRIBUTES, "label")


@query(f"""WITH {_LONG}, nl AS (SELECT label, count(*) AS nl FROM r GROUP BY 1), t AS (SELECT sum(nl) AS t, count(*) AS k FROM nl), b AS (SELECT attribute, count(DISTINCT value) + 1 AS b FROM cnt GROUP BY 1),
s AS (SELECT x.doc_id, nl.label, ln((nl.nl + 0.5) / (t.t + 0.5 * t.k)) AS prior, ln((coalesce(c.n, 0) + 0.5) / (nl.nl + 0.5 * b.b)) AS ll FROM lf x JOIN b USING (attribute) CROSS JOIN nl CROSS JOIN t LEFT JOIN cnt c ON c.attribute = x.attribute AND c.value = x.value AND c.label = nl.label)
SELECT doc_id, label, round(max(prior) + sum(ll), 9) AS score FROM s GROUP BY ALL""")
def nb_classify_quality(spark, d):
    r = _rows(spark, d)
    return L.bayes_scores(r, r, ATTRIBUTES, "label", "doc_id").withColumn("score", F.round("score", 9))


@query(f"WITH {_LONG}, k AS (SELECT count(DISTINCT label) AS k FROM r), nv AS (SELECT attribute, value, sum(n) AS nv FROM cnt GROUP BY ALL) SELECT attribute, value, label, round((n + 1) / (nv + k), 9) AS p FROM cnt JOIN nv USING (attribute, value), k")
def nb_class_given_value(spark, d):
    """The class share of each value, every count one up."""
    c = L.value_counts(_rows(spark, d), ATTRIBUTES, "label")
    k = c.agg(F.countDistinct("label").alias("k"))
    nv = c.groupBy("attribute", "value").agg(F.sum("n").alias("nv"))
    return c.join(nv, ["attribute", "value"]).crossJoin(F.broadcast(k)).select("attribute", "value", "label", F.round((F.col("n") + 1) / (F.col("nv") + F.col("k")), 9).alias("p"))


@query(f"WITH {_ROWS} SELECT label, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def zero_r(spark, d):
    return L.majority(_rows(spark, d), "label")


@query(f"WITH {_LONG}, v AS (SELECT attribute, value, sum(n) AS n, max(n) AS top FROM cnt GROUP BY ALL) SELECT attribute, round((sum(n) - sum(top)) / sum(n), 9) AS error FROM v GROUP BY 1")
def one_r(spark, d):
    return L.one_rule(L.value_counts(_rows(spark, d), ATTRIBUTES, "label")).withColumn("error", F.round("error", 9))


_STUMP = f"""{_LONG}, bl AS (SELECT attribute, label, sum(n) AS n FROM cnt GROUP BY ALL), tt AS (SELECT attribute, sum(n) AS t FROM cnt GROUP BY 1), root AS (SELECT attribute, sum(-(n / t) * log2(n / t)) AS root FROM bl JOIN tt USING (attribute) GROUP BY 1),
nv AS (SELECT attribute, value, sum(n) AS nv FROM cnt GROUP BY ALL), inn AS (SELECT attribute, value, max(nv) AS nv, sum(-(n / nv) * log2(n / nv)) AS h FROM cnt JOIN nv USING (attribute, value) GROUP BY ALL), mean AS (SELECT attribute, sum(nv * h) / sum(nv) AS mean, sum(nv + 1) AS s FROM inn GROUP BY 1),
sp AS (SELECT attribute, sum(-((nv + 1) / s) * log2((nv + 1) / s)) AS si FROM nv JOIN mean USING (attribute) GROUP BY 1), m AS (SELECT attribute, root - mean AS ig, si FROM root JOIN mean USING (attribute) JOIN sp USING (attribute))"""


@query(f"WITH {_STUMP} SELECT attribute, round(ig, 9) AS information_gain, round(si, 9) AS split_info, round(ig / si, 9) AS gain_ratio FROM m")
def stump_info_gain(spark, d):
    m = L.stump_measures(L.value_counts(_rows(spark, d), ATTRIBUTES, "label"))
    return m.select("attribute", *[F.round(c, 9).alias(c) for c in ("information_gain", "split_info", "gain_ratio")])


@query(f"WITH {_STUMP} SELECT attribute, row_number() OVER (ORDER BY round(ig, 9) DESC, attribute) AS rank FROM m")
def ig_rank_features(spark, d):
    m = L.stump_measures(L.value_counts(_rows(spark, d), ATTRIBUTES, "label"))  # a row per attribute
    return m.select("attribute", F.row_number().over(W.orderBy(F.desc(F.round("information_gain", 9)), "attribute")).cast("long").alias("rank"))


@query(f"WITH {_ROWS} SELECT doc_id, label, (row_number() OVER (ORDER BY label, doc_id) - 1) % 5 AS fold FROM r")
def cv_folds(spark, d):
    return L.folds(_rows(spark, d), "doc_id", "label", 5).select("doc_id", "label", F.col("fold").cast("long").alias("fold"))


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) * 10 / (hi - lo)), 9)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def equal_width_bins(spark, d):
    return L.equal_width(table(spark, d, "orders"), "o_totalprice", 10).groupBy("bin").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto FROM c), t AS (SELECT count(*) AS t FROM lineitem) SELECT i::INT AS i, min(v) AS cut FROM u, t, range(1, 10) g(i) WHERE upto * 10 >= i * t GROUP BY i")
def equal_freq_bins(spark, d):
    return L.equal_frequency_cuts(table(spark, d, "lineitem"), "l_quantity", 10)


@query("WITH c AS (SELECT l_quantity AS v, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT v, arg_max(k, n * 1000 - ascii(k)) AS k FROM c GROUP BY v), s AS (SELECT v, k, lag(v) OVER (ORDER BY v) AS pv, lag(k) OVER (ORDER BY v) AS pk FROM m) SELECT (v + pv) / 2 AS cut, pk AS below, k AS above FROM s WHERE pk <> k")
def supervised_breakpoints(spark, d):
    """Midpoints between neighbouring values whose majority class differs; classes are counted per value before anything is sorted."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v"), F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    m = c.groupBy("v").agg(F.max_by("k", F.col("n") * 1000 - F.ascii("k")).alias("k"))
    w = W.orderBy("v")
    s = m.withColumn("pv", F.lag("v").over(w)).withColumn("below", F.lag("k").over(w)).filter("below <> k")
    return s.select(((F.col("v") + F.col("pv")) / 2).alias("cut"), "below", F.col("k").alias("above"))


@query("WITH t AS (SELECT DISTINCT n_nationkey AS a, n_regionkey AS region FROM nation), q AS (SELECT s_suppkey AS k, s_nationkey AS x FROM supplier), x AS (SELECT k, region, abs(x - a) AS dist FROM q, t WHERE a <> x), m AS (SELECT k, min(dist) AS dist FROM x GROUP BY 1), v AS (SELECT k, region, count(*) AS n FROM x JOIN m USING (k, dist) GROUP BY ALL) SELECT k AS suppkey, arg_max(region, n * 1000 - region) AS region FROM v GROUP BY k")
def ib1_nn(spark, d):
    """Nearest neighbours by a nominal key: all ties at the smallest distance vote. The 25 labelled rows are the model."""
    train = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("region"))
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("x"))
    x = q.join(F.broadcast(train), F.col("a") != F.col("x")).withColumn("dist", F.abs(F.col("x") - F.col("a")))
    best = x.groupBy("suppkey").agg(F.min("dist").alias("m"))
    votes = x.join(best, "suppkey").filter("dist = m").groupBy("suppkey", "region").agg(F.count("*").alias("n"))
    return votes.groupBy("suppkey").agg(F.max_by("region", F.col("n") * 1000 - F.col("region")).alias("region"))


_TOK = "tk AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS token FROM documents)"
STUMPS = [("the", 1.0, -0.6, 0.4), ("der", 0.8, 0.1, -0.5), ("de", 0.5, 0.2, -0.3), ("und", 0.7, 0.05, -0.6), ("license", 0.9, 0.0, 0.9)]


@query(f"WITH {_TOK}, st AS (SELECT * FROM (VALUES {', '.join(f'{x!r}' for x in STUMPS)}) v(token, alpha, c0, c1)), n AS (SELECT sum(alpha) AS a, sum(alpha * c0) AS base, count(*) AS rounds FROM st), h AS (SELECT doc_id, sum(alpha * (c1 - c0)) AS d FROM tk JOIN st USING (token) GROUP BY 1), "
       "s AS (SELECT DISTINCT k.doc_id, (base + coalesce(d, 0)) / a AS score, rounds FROM tk k LEFT JOIN h USING (doc_id), n) SELECT doc_id, round(score::DOUBLE, 9) AS score, round(1 / (1 + exp(-2 * score::DOUBLE * rounds)), 9) AS posterior FROM s")
def boosting_score(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).filter("token <> ''")
    stumps = spark.createDataFrame(STUMPS, "token string, alpha double, c0 double, c1 double")
    return L.boosting_scores(f, stumps, "doc_id").select("doc_id", F.round("score", 9).alias("score"), F.round("posterior", 9).alias("posterior"))


@query(f"WITH {SENTS}, w AS (SELECT unnest(tok) AS word, topic_id FROM sent), s AS (SELECT word, right(word, 2) AS tag, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT left(word, 2) AS affix, tag, sum(n) AS n FROM s GROUP BY ALL) SELECT affix, arg_max(tag, n * 1000000 - ascii(tag) * 1000 - coalesce(ascii(substr(tag, 2, 1)), 0)) AS tag, sum(n)::BIGINT AS n FROM a GROUP BY affix")
def affix_tagger(spark, d):
    """A tagger's model: the commonest tag (here a word's ending) of each affix."""
    w = topic_sentences(spark, d).select(F.explode("tok").alias("word"))
    a = w.groupBy(F.substring("word", 1, 2).alias("affix"), F.substring("word", -2, 2).alias("tag")).agg(F.count("*").alias("n"))
    rank = F.col("n") * 1000000 - F.ascii("tag") * 1000 - F.ascii(F.substring("tag", 2, 1))
    return a.groupBy("affix").agg(F.max_by("tag", rank).alias("tag"), F.sum("n").alias("n"))


@query(f"WITH {SENTS}, b AS (SELECT topic_id, unnest(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) AS pair FROM sent), c AS (SELECT split_part(pair, ' ', 1) AS x, split_part(pair, ' ', 2) AS y, count(*) AS k FROM b GROUP BY ALL), cx AS (SELECT x, sum(k) AS nx FROM c GROUP BY 1), cy AS (SELECT y, sum(k) AS ny FROM c GROUP BY 1), n AS (SELECT sum(k) AS n FROM c) "
       "SELECT x, y, k, round(log2(k * n / (nx * ny)), 9) AS pmi FROM c JOIN cx USING (x) JOIN cy USING (y), n WHERE k >= 5")
def collocations(spark, d):
    """Neighbouring words seen five times or more, with their pointwise mutual information."""
    b = topic_sentences(spark, d).select(F.explode(F.transform(F.slice("tok", 1, F.greatest(F.size("tok") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("x"), F.get("tok", i + 1).alias("y")))).alias("p"))
    c = b.groupBy("p.x", "p.y").agg(F.count("*").alias("k"))
    cx, cy, n = c.groupBy("x").agg(F.sum("k").alias("nx")), c.groupBy("y").agg(F.sum("k").alias("ny")), c.agg(F.sum("k").alias("n"))
    return c.filter("k >= 5").join(cx, "x").join(cy, "y").crossJoin(F.broadcast(n)).select("x", "y", "k", F.round(F.log2(F.col("k") * F.col("n") / (F.col("nx") * F.col("ny"))), 9).alias("pmi"))


@query("WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w FROM documents), c AS (SELECT lower(rtrim(w, '.')) AS word, count(CASE WHEN w LIKE '%.' THEN 1 END) AS dotted, count(*) AS n FROM w GROUP BY 1) SELECT word, dotted, n, round(dotted / n, 9) AS share FROM c WHERE dotted > 0 AND n >= 3")
def abbreviation_counts(spark, d):
    """How often a word stands with a final period: the raw material of sentence-boundary models."""
    return SB.period_statistics(table(spark, d, "documents")).filter("dotted > 0 and n >= 3").withColumn("share", F.round("share", 9))


@query(None)
def boundary_classifier(spark, d):
    """Naive Bayes sentence boundaries, learned from line ends, per label and prediction."""
    frags = SB.fragments(table(spark, d, "documents"))
    scored = SB.score(frags, SB.train(frags))
    return scored.groupBy("label", (F.col("p") > 0.5).alias("predicted")).agg(F.count("*").alias("n"))


@query(None)
def stem_words(spark, d):
    return stem_table(topic_sentences(spark, d).select(F.explode("tok").alias("word")))


@query(None)
def kmeans_embeddings(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding")).alias("features"))
    return KMeans(k=8, seed=1).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query(None)
def mixture_embeddings(spark, d):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding")).alias("features"))
    return GaussianMixture(k=3, seed=1, maxIter=15).fit(v).transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query(None)
def decision_tree_quality(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    steps = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in [*ATTRIBUTES, "label"]]
    p = Pipeline(stages=[*steps, VectorAssembler(inputCols=[f"{c}_i" for c in ATTRIBUTES], outputCol="features"), DecisionTreeClassifier(labelCol="label_i", maxDepth=4)])
    r = _rows(spark, d)
    return p.fit(r).transform(r).select("doc_id", "label", F.col("prediction").cast("int").alias("predicted"))


def topic_model(spark, d, first: int | None = None):
    """LDA over the words of all documents in all languages; first: only so many sentences of each."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    sents = topic_sentences(spark, d)
    sents = sents if first is None else sents.filter(F.col("ord") < first)
    words = sents.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_distinct(T.without_stopwords(F.col("tok"), T.stopwords())))).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="features", minDF=2.0, vocabSize=2**31 - 1).fit(words).transform(words)
    model = LDA(k=5, maxIter=5, seed=1).fit(counts)
    return model.describeTopics(8).select("topic", "termIndices", "termWeights"), model.vocabSize()


@query(None)
def topics_lda(spark, d):
    return topic_model(spark, d)[0]

"""Concept weights, candidates, values, selection input and summaries by topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.operators import concepts as C
from brevis.operators import selection as S
from brevis.sources.scratch import stored
from brevis.sources.tables import sentences, stemmed_sentences, table, topic_queries, topic_sentences, topics

from .registry import OCC, OVER, SENTS, TOPICS, grams, no_stop, production, query, tokens

STOPWORDS = T.stopwords()


def overlapped(spark: SparkSession, d: str, docset: str | None = None, stem: bool = False) -> DataFrame:
    """Sentences with words, or stems of words, and query overlap, of one docset or both."""
    s = (stemmed_sentences if stem else topic_sentences)(spark, d).withColumnRenamed("tok", "words")
    s = s.filter(F.col("docset") == docset) if docset else s
    return C.with_overlap(s.drop("docset"), topic_queries(spark, d), STOPWORDS, stem=stem)


@query(f"WITH {OVER} SELECT doc_id, ord, overlap FROM over_")
def query_overlap(spark, d):
    return overlapped(spark, d).select("doc_id", "ord", "overlap")


@query(f"WITH {production('A', 1, 3, 1)} SELECT * FROM marks")
def concept_markers_a(spark, d):
    return C.markers(overlapped(spark, d, "A"), C.RULES["A"])


@query(f"WITH {production('B', 2, 4, 0)} SELECT * FROM marks")
def concept_markers_b(spark, d):
    return C.markers(overlapped(spark, d, "B"), C.RULES["B"])


@query(f"WITH {production('A', 1, 3, 1)} SELECT * FROM weights")
def concept_weights_production_a(spark, d):
    return C.production_weights(overlapped(spark, d, "A"), C.RULES["A"], STOPWORDS)


@query(f"WITH {production('B', 2, 4, 0)} SELECT * FROM weights")
def concept_weights_production_b(spark, d):
    return C.production_weights(overlapped(spark, d, "B"), C.RULES["B"], STOPWORDS)


@query(f"WITH {OCC} SELECT topic_id, concept, count(DISTINCT doc_id) + count(DISTINCT CASE WHEN ord = 0 THEN doc_id END) AS weight FROM occ WHERE overlap >= 1 GROUP BY ALL")
def concept_weights_baseline(spark, d):
    return C.baseline_weights(overlapped(spark, d))


_GOLD = f"gold AS (SELECT 't' || (conv_id % 20) AS topic_id, conv_id AS annotator, unnest(list_distinct({grams('w', 2)})) AS concept FROM (SELECT conv_id, {tokens('text')} AS w FROM conversations WHERE role = 'assistant'))"


def _gold(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.select(F.concat(F.lit("t"), F.col("conv_id") % 20).alias("topic_id"), F.col("conv_id").alias("annotator"), "text")


@query(f"WITH {_GOLD} SELECT topic_id, concept, count(DISTINCT annotator) AS weight FROM gold GROUP BY ALL")
def concept_weights_gold(spark, d):
    return C.gold_weights(_gold(spark, d))


@query(None)
def concept_weights_stemmed(spark, d):
    """Production weights of bigrams of stems, of both docsets, each under its own rules."""
    a, b = (C.production_weights(overlapped(spark, d, docset, stem=True), C.RULES[docset], STOPWORDS) for docset in ("A", "B"))
    return a.unionByName(b)


@query(f"WITH {OCC}, n AS (SELECT topic_id, count(DISTINCT doc_id) AS n_docs FROM over_ GROUP BY 1), w AS (SELECT topic_id, concept, count(DISTINCT doc_id) AS df, count(*) AS tf FROM occ GROUP BY ALL) SELECT topic_id, concept, CASE WHEN n_docs > 3 THEN df ELSE tf END AS weight FROM w JOIN n USING (topic_id) WHERE CASE WHEN n_docs > 3 THEN df ELSE tf END >= 3")
def concept_df_or_tf(spark, d):
    return C.df_or_tf(overlapped(spark, d))


@query(f"WITH {SENTS}, o AS (SELECT topic_id, ord, unnest({grams('tok', 2)}) AS concept FROM sent WHERE length >= 5) SELECT topic_id, concept, round(max(1.0 / (ord + 1)), 9) AS weight FROM o GROUP BY ALL")
def concept_location_weights(spark, d):
    return C.location_weights(overlapped(spark, d)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {production('A', 1, 3, 1)} SELECT topic_id, doc_id, ord, length FROM cands")
def candidate_sentences(spark, d):
    return C.candidates(overlapped(spark, d, "A")).select("topic_id", "doc_id", "ord", "length")


@query(f"WITH {SENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, array_to_string(tok, ' ') ORDER BY doc_id, ord) AS rn FROM sent WHERE length >= 5 AND NOT regexp_matches(orig, '^[\"(].*[\")]$')) SELECT topic_id, count(*) AS n_distinct, sum(length)::BIGINT AS n_words FROM r WHERE rn = 1 GROUP BY 1")
def candidate_dedupe(spark, d):
    return C.candidates(overlapped(spark, d), 5).groupBy("topic_id").agg(F.count("*").alias("n_distinct"), F.sum("length").alias("n_words"))


_INC = f"{production('A', 1, 3, 1)}, inc AS (SELECT o.topic_id, o.doc_id, o.ord, o.concept FROM occ o JOIN cands c ON (o.doc_id, o.ord) = (c.doc_id, c.ord) JOIN weights w ON (o.topic_id, o.concept) = (w.topic_id, w.concept))"


@query(f"WITH {_INC} SELECT * FROM inc")
def concept_incidence(spark, d):
    s = overlapped(spark, d, "A")
    return C.incidence(C.candidates(s), C.production_weights(s, C.RULES["A"], STOPWORDS))


@query(f"WITH {_INC}, h AS (SELECT topic_id, doc_id, ord, count(*) AS n FROM inc GROUP BY ALL) SELECT n AS n_concepts, count(*) AS n_sentences FROM h GROUP BY n")
def sent_histogram(spark, d):
    return concept_incidence(spark, d).groupBy("topic_id", "doc_id", "ord").agg(F.count("*").alias("n_concepts")).groupBy("n_concepts").agg(F.count("*").alias("n_sentences"))


@query(f"WITH {_INC}, p AS (SELECT concept, count(*) AS n, list_sort(list(doc_id || ':' || ord)) AS l FROM inc GROUP BY topic_id, concept) SELECT concept, n, array_to_string(l, ',') AS postings FROM p")
def inverted_index(spark, d):
    p = concept_incidence(spark, d).groupBy("topic_id", "concept").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat_ws(":", "doc_id", "ord"))).alias("l"))
    return p.select("concept", "n", F.array_join("l", ",").alias("postings"))


_VAL = f"""{OCC}, tot AS (SELECT topic_id, sum(overlap) AS t FROM over_ GROUP BY 1), v0 AS (SELECT topic_id, doc_id, ord, overlap / t AS value FROM over_ JOIN tot USING (topic_id) WHERE overlap > 0),
c0 AS (SELECT topic_id, concept, sum(value) AS v FROM occ JOIN v0 USING (topic_id, doc_id, ord) GROUP BY ALL), c1 AS (SELECT topic_id, concept, v / sum(v) OVER (PARTITION BY topic_id) AS value FROM c0),
s0 AS (SELECT topic_id, doc_id, ord, sum(value) AS v FROM occ JOIN c1 USING (topic_id, concept) GROUP BY ALL), s1 AS (SELECT topic_id, doc_id, ord, v / sum(v) OVER (PARTITION BY topic_id) AS value FROM s0),
d0 AS (SELECT topic_id, concept, sum(value) AS v FROM occ JOIN s1 USING (topic_id, doc_id, ord) GROUP BY ALL), c2 AS (SELECT topic_id, concept, v / sum(v) OVER (PARTITION BY topic_id) AS value FROM d0)"""


@query(f"WITH {_VAL} SELECT topic_id, concept, round(value, 9) AS value FROM c1")
def concept_values_exp(spark, d):
    return C.query_expand(overlapped(spark, d), rounds=1).withColumn("value", F.round("value", 9))


@query(f"WITH {_VAL} SELECT topic_id, doc_id, ord, round(value, 9) AS value FROM s1")
def sent_concept_round1(spark, d):
    s = overlapped(spark, d)
    occ = C.occurrences(s)
    return C.propagate_to_sentences(C.propagate_to_concepts(C.sentence_values(s), occ), occ).withColumn("value", F.round("value", 9))


@query(f"WITH {_VAL} SELECT topic_id, concept, round(value, 9) AS value FROM c2")
def sent_concept_round2(spark, d):
    return C.query_expand(overlapped(spark, d)).withColumn("value", F.round("value", 9))


@query(f"WITH {_VAL}, r AS (SELECT topic_id, concept, value, row_number() OVER (PARTITION BY topic_id ORDER BY round(value, 9) DESC, concept) AS rank FROM c2) SELECT topic_id, concept, rank FROM r WHERE rank <= 65")
def top65_concepts(spark, d):
    return C.top_concepts(C.query_expand(overlapped(spark, d)).withColumn("value", F.round("value", 9))).select("topic_id", "concept", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SENTS} SELECT topic_id, w AS word, 1.0::DOUBLE / count(DISTINCT doc_id) AS idf FROM (SELECT topic_id, doc_id, unnest(tok) AS w FROM sent) GROUP BY ALL")
def idf_inverse_df(spark, d):
    w = topic_sentences(spark, d).select("topic_id", "doc_id", F.explode("tok").alias("word"))
    return w.groupBy("topic_id", "word").agg((1.0 / F.countDistinct("doc_id")).alias("idf"))


_COS = f"""{SENTS}, tf AS (SELECT topic_id, doc_id, ord, w, count(*) AS tf FROM (SELECT topic_id, doc_id, ord, unnest({no_stop('tok')}) AS w FROM sent) GROUP BY ALL), dtf AS (SELECT doc_id, w, sum(tf)::BIGINT AS dtf FROM tf GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(dtf * dtf)) AS dn FROM dtf GROUP BY 1), sn AS (SELECT doc_id, ord, sqrt(sum(tf * tf)) AS sn FROM tf GROUP BY ALL),
dot AS (SELECT t.doc_id, t.ord, sum(t.tf * d.dtf) AS dot FROM tf t JOIN dtf d ON t.doc_id = d.doc_id AND t.w = d.w GROUP BY ALL)"""


@query(f"WITH {_COS} SELECT doc_id, ord, round(dot / (sn * dn), 9) AS cosine, round(dot / (sn * dn) + CASE WHEN ord = 0 THEN 1 ELSE 0 END, 9) AS relevance FROM dot JOIN sn USING (doc_id, ord) JOIN dn USING (doc_id)")
def centroid_relevance(spark, d):
    """Cosine of a sentence with its document, and one more for the first sentence."""
    s = topic_sentences(spark, d).withColumn("w", F.explode(T.without_stopwords(F.col("tok"), STOPWORDS)))
    # one shuffle, of hashed words by document; a document's squared norm is the sum of its sentences' products with it
    tf = s.select("doc_id", "ord", F.xxhash64("w").alias("w")).repartition("doc_id").groupBy("doc_id", "ord", "w").agg(F.count("*").alias("tf"))
    dtf = tf.withColumn("dtf", F.sum("tf").over(W.partitionBy("doc_id", "w")))
    dot = dtf.groupBy("doc_id", "ord").agg(F.sum(F.col("tf") * F.col("dtf")).alias("dot"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("sn"))
    c = F.col("dot") / (F.col("sn") * F.sqrt(F.sum("dot").over(W.partitionBy("doc_id"))))
    return dot.select("doc_id", "ord", F.round(c, 9).alias("cosine"), F.round(c + F.when(F.col("ord") == 0, 1).otherwise(0), 9).alias("relevance"))


@query(f"WITH {SENTS}, w AS (SELECT topic_id, doc_id, ord, unnest(list_distinct(list_filter({no_stop('tok')}, lambda x: len(x) >= 8))) AS w FROM sent WHERE docset = 'A') SELECT a.topic_id, a.w AS a, b.w AS b, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.ord = b.ord AND a.w < b.w GROUP BY ALL HAVING count(*) > 1")
def cooccurrence_counts(spark, d):
    s = topic_sentences(spark, d).filter("docset = 'A'").withColumnRenamed("tok", "words")
    return C.cooccurrence(s, STOPWORDS).filter("n > 1")


@query(f"WITH {TOPICS}, s AS (SELECT DISTINCT source, docset FROM topics) SELECT a.source || '-' || a.docset AS topic_id, t.doc_id AS old_doc FROM s a JOIN topics t ON t.source = a.source AND t.docset < a.docset")
def old_docs_accumulate(spark, d):
    """The documents of a topic's earlier docsets."""
    t = topics(spark, d)
    later = t.select("source", F.col("docset").alias("own")).distinct()
    return t.join(later, "source").filter("docset < own").select(F.concat_ws("-", "source", "own").alias("topic_id"), F.col("doc_id").alias("old_doc"))


@query(f"WITH {OCC}, g AS (SELECT DISTINCT topic_id, concept FROM occ WHERE docset = 'A' AND overlap >= 1), w AS (SELECT topic_id, concept, count(DISTINCT doc_id) AS df FROM occ WHERE docset = 'A' GROUP BY ALL), b AS (SELECT DISTINCT topic_id, concept FROM occ WHERE docset = 'A' AND ord = 0) SELECT topic_id, coalesce(sum((w.concept IS NOT NULL AND b.concept IS NOT NULL)::INT), 0)::BIGINT AS in_both, sum((b.concept IS NULL)::INT)::BIGINT AS only_mapper FROM w LEFT JOIN b USING (topic_id, concept) GROUP BY topic_id")
def concept_compare(spark, d):
    """Concepts that a topic's first sentences share with all its sentences, and those that they lack."""
    occ = C.occurrences(overlapped(spark, d, "A"))
    allc = occ.select("topic_id", "concept").distinct()
    lead = occ.filter("ord = 0").select("topic_id", "concept", F.lit(1).alias("has")).distinct()
    return allc.join(lead, ["topic_id", "concept"], "left").groupBy("topic_id").agg(F.sum(F.coalesce("has", F.lit(0))).cast("long").alias("in_both"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).cast("long").alias("only_mapper"))


@query(f"WITH {TOPICS} SELECT topic_id, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS in_order FROM topics GROUP BY topic_id")
def by_date(spark, d):
    """Documents of a topic in date order; zero-padded ids stand for dates."""
    return topics(spark, d).groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("in_order"))


_TOP2 = f"{production('A', 1, 3, 1)}, pick AS (SELECT topic_id, doc_id, ord, length, row_number() OVER (PARTITION BY topic_id ORDER BY overlap DESC, doc_id, ord) AS rn FROM cands), sel AS (SELECT * FROM pick WHERE rn <= 5)"


@query(f"""WITH {_TOP2}, o AS (SELECT *, first(ord) OVER (PARTITION BY topic_id ORDER BY doc_id, ord) AS f_ord, min(CASE WHEN ord = 0 THEN lpad((10000 - length)::VARCHAR, 6, '0') || lpad(doc_id::VARCHAR, 12, '0') END) OVER (PARTITION BY topic_id) AS lead_ FROM sel),
k AS (SELECT *, CASE WHEN lead_ IS NULL OR f_ord = 0 THEN 0 WHEN doc_id = substr(lead_, 7)::BIGINT AND ord = 0 THEN 0 WHEN doc_id = substr(lead_, 7)::BIGINT THEN 1 ELSE 2 END AS key FROM o)
SELECT topic_id, doc_id, ord, row_number() OVER (PARTITION BY topic_id ORDER BY key, doc_id, ord) AS pos FROM k""")
def order_promote_first(spark, d):
    """Five candidates a topic, by overlap, put in reading order."""
    c = C.candidates(overlapped(spark, d, "A"))
    five = c.withColumn("rn", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("overlap"), "doc_id", "ord"))).filter("rn <= 5").withColumn("rank", F.lit(0))
    return S.promote_first(five.select("topic_id", "rank", "doc_id", "ord", "length")).select("topic_id", "doc_id", "ord", F.col("pos").cast("long").alias("pos"))


def _selected(spark, d, docset, method, stem=True, **kw):
    s = overlapped(spark, d, docset, stem)
    w = stored(C.production_weights(s, C.RULES[docset], STOPWORDS), "weights")
    c = stored(C.candidates(s).select("topic_id", "doc_id", "ord", "length", "words"), "candidates")
    return S.select(c, C.incidence(c, w), w, method, **kw), s


def _selected_of_both(spark, d, method, **kw):
    """The selections of all topics, each docset under its own rules."""
    a, b = (_selected(spark, d, docset, method, **kw)[0] for docset in ("A", "B"))
    return a.unionByName(b)


@query(None)
def select_greedy(spark, d):
    return _selected_of_both(spark, d, "greedy")


@query(None)
def select_exact(spark, d):
    return _selected_of_both(spark, d, "exact")


@query(None)
def select_nbest(spark, d):
    return _selected_of_both(spark, d, "exact", n=2)


@query(None)
def select_swap(spark, d):
    return _selected_of_both(spark, d, "swap")


def summaries(spark: SparkSession, d: str, docset: str = "A", method: str = "exact", stem: bool = True) -> DataFrame:
    """(topic_id, rank, pos, doc_id, ord, text): ordered summary sentences."""
    chosen, s = _selected(spark, d, docset, method, stem)
    full = chosen.join(s.select("topic_id", "doc_id", "ord", "length", F.col("orig").alias("text")), ["topic_id", "doc_id", "ord"])
    return S.promote_first(full.select("topic_id", "rank", "doc_id", "ord", "length", "text")).select("topic_id", "rank", "pos", "doc_id", "ord", "text")


@query(None)
def summarize(spark, d):
    """Summaries of both docsets, each under its own rules."""
    return summaries(spark, d, "A").unionByName(summaries(spark, d, "B"))

"""Concept mappers beside the production one, small exact selections, score reports and taggers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.operators import concepts as C
from brevis.operators import learning as L
from brevis.operators import selection as S
from brevis.sources.scratch import stored
from brevis.sources.tables import table, topic_sentences, topics

from . import statistics_queries  # noqa: F401  its oracles are parts of some here
from .concept_queries import STOPWORDS, _gold, overlapped
from .registry import OCC, ORACLES, OVER, QUERIES, SENTS, SPLIT, TOPICS, all_stop, grams, no_stop, production, query, tokens, words_of
from .text_queries import AGGRESSIVE, CLEANING

_FIRST = "row_number() OVER (PARTITION BY topic_id, array_to_string(tok, ' ') ORDER BY doc_id, ord) = 1"


@query(f"SELECT topic_id, concept, count(DISTINCT annotator) AS weight FROM (SELECT 't' || (conv_id % 20) AS topic_id, conv_id AS annotator, unnest(list_distinct({grams('w', 2)})) AS concept FROM (SELECT conv_id, text, {tokens('text')} AS w FROM conversations WHERE role = 'assistant') WHERE len({words_of('text')}) >= 5) GROUP BY ALL")
def concept_weights_cheating(spark, d):
    """Annotators by concept, over lines of five words or more."""
    return C.gold_weights(_gold(spark, d).filter(T.n_words(F.col("text")) >= 5))


@query(f"WITH {OVER}, k AS (SELECT * FROM over_ WHERE length >= 5 AND overlap > 0 QUALIFY {_FIRST}), n AS (SELECT topic_id, count(DISTINCT doc_id) AS n FROM k GROUP BY 1), o AS (SELECT topic_id, doc_id, ord, unnest(list_distinct({grams('tok', 2)})) AS concept FROM k), w AS (SELECT topic_id, concept, CASE WHEN any_value(n) > 3 THEN count(DISTINCT doc_id) ELSE count(*) END AS weight FROM o JOIN n USING (topic_id) GROUP BY ALL) SELECT * FROM w WHERE weight >= 3 AND NOT {all_stop("string_split(concept, '_')")}")
def concept_weights_heuristic(spark, d):
    return C.heuristic_weights(overlapped(spark, d), STOPWORDS)


@query(f"WITH {OVER}, k AS (SELECT * FROM over_ WHERE length > 5 QUALIFY {_FIRST}) SELECT topic_id, doc_id, min(ord) AS ord FROM k GROUP BY ALL")
def lead_candidates(spark, d):
    return C.lead_candidates(overlapped(spark, d))


@query(f"WITH {TOPICS}, l AS (SELECT topic_id, doc_id, string_split(text, chr(10)) AS l FROM topics), p AS (SELECT topic_id, doc_id, unnest(l) AS text, unnest(range(0, len(l)))::INT AS par FROM l), s AS (SELECT topic_id, doc_id, par, ({SPLIT})[1] AS orig FROM p) SELECT topic_id, doc_id, par, orig FROM s WHERE len({words_of('orig')}) >= 20 QUALIFY row_number() OVER (PARTITION BY topic_id, orig ORDER BY doc_id, par) = 1")
def paragraph_starters(spark, d):
    """Candidates beside gold summaries: paragraph starters of 20 words or more."""
    return C.paragraph_starters(topics(spark, d))


@query(f"WITH {production('A', 1, 3, 1)}, {CLEANING}, agg AS (SELECT doc_id, ord, cleaned, {AGGRESSIVE} AS tight FROM cleaned), v AS (SELECT s.topic_id, s.doc_id, s.ord, list_filter([s.orig, CASE WHEN g.cleaned <> s.orig THEN g.cleaned END, CASE WHEN g.tight <> s.orig AND g.tight <> g.cleaned THEN g.tight END], lambda x: x IS NOT NULL) AS l FROM sent s JOIN agg g USING (doc_id, ord) WHERE s.docset = 'A'), "
       f"f AS (SELECT topic_id, doc_id, ord, unnest(l) AS orig, unnest(range(0, len(l)))::INT AS variant FROM v), t AS (SELECT *, {tokens('orig')} AS tok FROM f WHERE len({words_of('orig')}) >= 10 AND NOT regexp_matches(orig, '^[\"(].*[\")]$')), o AS (SELECT DISTINCT topic_id, doc_id, ord, variant, unnest({grams('tok', 2)}) AS concept FROM t) SELECT o.* FROM o JOIN weights w ON o.topic_id = w.topic_id AND o.concept = w.concept")
def concept_incidence_variants(spark, d):
    """Concepts weighed on originals, found in their wordings."""
    s = overlapped(spark, d, "A")
    return C.variant_incidence(s, C.production_weights(s, C.RULES["A"], STOPWORDS))


@query(f"WITH {production('A', 1, 3, 1)}, e AS (SELECT topic_id, '__ie__:' || num AS concept, count(DISTINCT doc_id) * 2.0::DOUBLE AS weight FROM (SELECT topic_id, doc_id, unnest(list_filter(tok, lambda x: regexp_matches(x, '^[0-9]+$'))) AS num FROM sent WHERE docset = 'A') GROUP BY ALL) SELECT topic_id, concept, weight::DOUBLE AS weight FROM weights UNION ALL SELECT topic_id, concept, weight FROM e")
def concept_weights_entities(spark, d):
    """Production concepts, and numbers as the concepts of an extractor."""
    s = overlapped(spark, d, "A")
    numbers = s.select("topic_id", "doc_id", F.explode(F.filter("words", lambda x: x.rlike("^[0-9]+$"))).alias("entity"))
    return C.with_entities(C.production_weights(s, C.RULES["A"], STOPWORDS), numbers, 2.0)


@query(f"WITH {SENTS} SELECT doc_id, ord FROM sent WHERE regexp_matches(orig, '[0-9]')")
def flagged_sentences(spark, d):
    lines = topic_sentences(spark, d).withColumn("line", F.concat("orig", F.lit("|"), F.col("orig").rlike("[0-9]").cast("int").cast("string")))
    return C.flagged(C.flagged(lines, "line", "1", True), "line", "0", False).select("doc_id", "ord")


@query(f"WITH {OCC}, f AS (SELECT topic_id, concept, count(DISTINCT doc_id) AS v FROM occ GROUP BY ALL) SELECT topic_id, concept, round(v / sum(v) OVER (PARTITION BY topic_id), 12) AS value FROM f")
def document_reinforcement(spark, d):
    return C.document_reinforcement(C.occurrences(overlapped(spark, d))).withColumn("value", F.round("value", 12))


@query(f"WITH {SENTS}, tf AS (SELECT topic_id, doc_id, ord, w, count(*) AS tf FROM (SELECT topic_id, doc_id, ord, unnest({no_stop('tok')}) AS w FROM sent) GROUP BY ALL), idf AS (SELECT topic_id, w, 1.0::DOUBLE / count(DISTINCT doc_id) AS idf FROM tf GROUP BY ALL), dtf AS (SELECT topic_id, doc_id, w, sum(tf)::BIGINT AS dtf FROM tf GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(dtf * dtf)) AS dn FROM dtf GROUP BY 1) "
       "SELECT t.doc_id, t.ord, round(sum(t.tf * d.dtf * i.idf * i.idf) / (sqrt(sum(t.tf * t.tf)) * any_value(dn.dn)), 9) AS cosine FROM tf t JOIN dtf d ON t.doc_id = d.doc_id AND t.w = d.w JOIN idf i ON i.topic_id = t.topic_id AND i.w = t.w JOIN dn ON dn.doc_id = t.doc_id GROUP BY ALL")
def centroid_cosine_idf(spark, d):
    """Cosine of a sentence with its document, words weighed by the square of one over their documents, norms by counts alone."""
    s = topic_sentences(spark, d).withColumn("w", F.explode(T.without_stopwords(F.col("tok"), STOPWORDS)))
    tf = stored(s.groupBy("topic_id", "doc_id", "ord", F.xxhash64("w").alias("w")).agg(F.count("*").alias("tf")), "counts")
    idf = tf.groupBy("topic_id", "w").agg((1.0 / F.countDistinct("doc_id")).alias("idf"))
    both = tf.join(idf, ["topic_id", "w"]).repartition("doc_id").withColumn("dtf", F.sum("tf").over(W.partitionBy("doc_id", "w")))
    n, one = F.col("tf") * F.col("dtf"), F.col("idf") * F.col("idf")
    per = both.groupBy("doc_id", "ord").agg(F.sum(n * one).alias("dot"), F.sum(n).alias("n"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("sn"))
    return per.select("doc_id", "ord", F.round(F.col("dot") / (F.col("sn") * F.sqrt(F.sum("n").over(W.partitionBy("doc_id")))), 9).alias("cosine"))


_EIGHT = f"""{production('A', 1, 3, 1)}, inc AS (SELECT o.topic_id, o.doc_id, o.ord, o.concept, w.weight FROM occ o JOIN cands c ON (o.doc_id, o.ord) = (c.doc_id, c.ord) JOIN weights w ON (o.topic_id, o.concept) = (w.topic_id, w.concept)),
eight AS (SELECT topic_id, doc_id, ord, length, (row_number() OVER (PARTITION BY topic_id ORDER BY overlap DESC, doc_id, ord) - 1)::INT AS i FROM cands QUALIFY i < 8),
used AS (SELECT * FROM eight e WHERE EXISTS (SELECT 1 FROM inc WHERE inc.doc_id = e.doc_id AND inc.ord = e.ord)), sets AS (SELECT DISTINCT topic_id, unnest(range(1, 256)) AS m FROM used),
words AS (SELECT s.topic_id, s.m, sum(u.length) AS n FROM sets s JOIN used u ON u.topic_id = s.topic_id AND (s.m >> u.i) & 1 = 1 GROUP BY ALL), masks AS (SELECT topic_id, concept, any_value(weight) AS weight, bit_or((1 << i)::BIGINT) AS mask FROM inc JOIN used USING (topic_id, doc_id, ord) GROUP BY ALL),
value AS (SELECT w.topic_id, w.m, sum(k.weight) - 0.001 * any_value(w.n) AS v FROM words w JOIN masks k ON k.topic_id = w.topic_id AND k.mask & w.m <> 0 WHERE w.n <= 100 GROUP BY ALL)"""


@query(f"WITH {_EIGHT} SELECT topic_id, round(max(v), 6)::DOUBLE AS objective FROM value GROUP BY topic_id")
def select_exact_small(spark, d):
    """The best objective among the eight candidates with most overlap: the oracle enumerates their subsets."""
    s = overlapped(spark, d, "A")
    w = stored(C.production_weights(s, C.RULES["A"], STOPWORDS), "weights")
    order = W.partitionBy("topic_id").orderBy(F.desc("overlap"), "doc_id", "ord")
    eight = stored(C.candidates(s).withColumn("i", F.row_number().over(order)).filter("i <= 8"), "candidates")
    chosen = S.select(eight, C.incidence(eight, w), w, "exact")
    return chosen.groupBy("topic_id").agg(F.round(F.max("objective"), 6).alias("objective"))


@query(None)
def selection_check(spark, d):
    """Whether the exact selections keep their budget and hold candidates only."""
    cands = C.candidates(overlapped(spark, d, stem=True))
    return S.consistency(QUERIES["select_exact"](spark, d), cands)


_RUNS = " UNION ALL ".join(f"SELECT '{m}' AS metric, topic_id, peer_id, recall FROM ({ORACLES[f'rouge_{m}']})" for m in ("1", "2", "3", "4"))
_KIND = "CASE WHEN regexp_extract(topic_id, '([0-9]+)', 1)::INT % 2 = 0 THEN 'A' ELSE 'B' END"


def _runs(spark, d):
    parts = [QUERIES[f"rouge_{m}"](spark, d).select(F.lit(m).alias("metric"), "topic_id", "peer_id", "recall") for m in "1234"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH r AS ({_RUNS}), k AS (SELECT *, {_KIND} AS docset FROM r) SELECT metric, coalesce(docset, 'all') AS docset, round(avg(recall), 6) AS recall FROM k GROUP BY GROUPING SETS ((metric, docset), (metric))")
def rouge_report(spark, d):
    """Average rows of a report: by metric and docset, and by metric."""
    k = _runs(spark, d).withColumn("docset", F.when(F.regexp_extract("topic_id", "([0-9]+)", 1).cast("int") % 2 == 0, "A").otherwise("B"))
    g = k.groupingSets([["metric", "docset"], ["metric"]], "metric", "docset").agg(F.round(F.avg("recall"), 6).alias("recall"))
    return g.select("metric", F.coalesce("docset", F.lit("all")).alias("docset"), "recall")


@query(f"WITH r AS ({_RUNS}) SELECT topic_id, peer_id, max(CASE WHEN metric = '1' THEN recall END) AS r1, max(CASE WHEN metric = '2' THEN recall END) AS r2, max(CASE WHEN metric = '3' THEN recall END) AS r3, max(CASE WHEN metric = '4' THEN recall END) AS r4 FROM r GROUP BY ALL")
def run_score_pivot(spark, d):
    """A row per topic, a column per run."""
    p = _runs(spark, d).groupBy("topic_id", "peer_id").pivot("metric", list("1234")).agg(F.max("recall"))
    return p.select("topic_id", "peer_id", *[F.col(m).alias(f"r{m}") for m in "1234"])


_TAGS = "w AS (SELECT doc_id, lang AS tag, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang IS NOT NULL), train AS (SELECT word, tag, count(*) AS n FROM w WHERE doc_id % 10 > 1 GROUP BY ALL), own AS (SELECT word, arg_min(tag, (-n, tag)) AS tag FROM train GROUP BY 1), e AS (SELECT right(word, 3) AS k, tag, sum(n) AS n FROM train GROUP BY ALL), like_ AS (SELECT k, arg_min(tag, (-n, tag)) AS tag FROM e GROUP BY 1), test AS (SELECT DISTINCT word FROM w WHERE doc_id % 10 = 0)"


@query(f"WITH {_TAGS} SELECT word, coalesce(own.tag, like_.tag, 'en') AS tag, CASE WHEN own.tag IS NOT NULL THEN 'word' WHEN like_.tag IS NOT NULL THEN 'ending' ELSE 'default' END AS source FROM test LEFT JOIN own USING (word) LEFT JOIN like_ ON like_.k = right(word, 3)")
def backoff_tagger(spark, d):
    """Words of held-out documents, tagged with a language by word, else by ending, else by default."""
    docs = L.split_by_id(table(spark, d, "documents").filter("lang is not null"), "doc_id")
    w = docs.select("part", F.col("lang").alias("tag"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    train = stored(w.filter("part = 'train'").groupBy("word", "tag").agg(F.count("*").alias("n")), "tags")
    return L.backoff_tags(train, w.filter("part = 'test'").select("word").distinct(), "en")


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS part, count(*) AS n FROM documents GROUP BY 1")
def split_sizes(spark, d):
    return L.split_by_id(table(spark, d, "documents"), "doc_id").groupBy("part").agg(F.count("*").alias("n"))

"""Dumps of cleaned sentences, checks of what is loaded, concepts in texts, merged counts and a continuous classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.operators import concepts as C
from brevis.operators import learning as L
from brevis.operators import statistics as S
from brevis.sources import corpora
from brevis.sources.tables import table, topic_queries, topic_sentences, topics

from .registry import SENTS, TOPICS, grams, query, tokens
from .text_queries import AGGRESSIVE, CLEANING


@query(f"WITH {SENTS}, {CLEANING}, hard AS (SELECT doc_id, ord, cleaned, {AGGRESSIVE} AS tight FROM cleaned) SELECT topic_id, doc_id, (row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY ord) - 1)::INT AS ord, CASE WHEN ord = 0 THEN tight ELSE cleaned END AS text FROM sent JOIN hard USING (doc_id, ord) WHERE NOT (orig[1:2] = lower(orig[1:2]) AND orig[1:2] <> upper(orig[1:2]))")
def column_dump(spark, d):
    """Sentences of all topics as dumped and loaded again."""
    return corpora.renumbered(corpora.column_rows(topic_sentences(spark, d)))


@query(f"WITH {SENTS}, k AS (SELECT DISTINCT topic_id, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS k FROM topics), p AS (SELECT EXISTS (SELECT 1 FROM sent s WHERE s.topic_id = k.topic_id) AS sentences, EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = k.k) AS query, EXISTS (SELECT 1 FROM conversations c WHERE c.role = 'assistant' AND c.conv_id % 20 = k.k) AS gold FROM k) SELECT coalesce(bool_and(sentences), true) AS sentences, coalesce(bool_and(query), true) AS query, coalesce(bool_and(gold), true) AS gold FROM p")
def state_check(spark, d):
    """Whether all topics have sentences, a query and gold texts."""
    all_ = topics(spark, d).select("topic_id", F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("k")).distinct()
    has = topic_sentences(spark, d).select("topic_id", F.lit(True).alias("sentences")).distinct()
    asked = topic_queries(spark, d).select("topic_id", F.lit(True).alias("query")).distinct()
    gold = table(spark, d, "conversations").filter("role = 'assistant'").select((F.col("conv_id") % 20).alias("k"), F.lit(True).alias("gold")).distinct()
    return corpora.loaded(all_.join(has, "topic_id", "left").join(asked, "topic_id", "left").join(gold, "k", "left"), ["sentences", "query", "gold"])


@query(f"""WITH w AS (SELECT conv_id, turn, role, {tokens('text')} AS w FROM conversations), c AS (SELECT conv_id, list_sort(list_distinct(flatten(list({grams('w', 2)})))) AS cs FROM w WHERE role = 'user' GROUP BY 1),
s AS (SELECT conv_id, turn, list_concat([{{'t': ' ' || array_to_string(w, ' ') || ' ', 'f': []::VARCHAR[], 'c': ''}}], list_transform(cs, lambda x: {{'t': '', 'f': []::VARCHAR[], 'c': x}})) AS l FROM w JOIN c USING (conv_id) WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, list_reduce(l, lambda a, x: CASE WHEN contains(a.t, ' ' || replace(x.c, '_', ' ') || ' ') THEN {{'t': replace(a.t, ' ' || replace(x.c, '_', ' ') || ' ', ' <MATCHED> '), 'f': list_append(a.f, x.c), 'c': ''}} ELSE a END) AS r FROM s)
SELECT conv_id, turn, len(r.f)::INT AS n_found, array_to_string(r.f, ',') AS found FROM r""")
def concepts_in_text(spark, d):
    """Bigrams of a conversation's user, by name, that are found in each answer."""
    w = table(spark, d, "conversations").select("conv_id", "turn", "role", T.tokenize(F.col("text")).alias("w"))
    asked = w.filter("role = 'user'").select("conv_id", F.explode(T.ngrams(F.col("w"), 2)).alias("c")).groupBy("conv_id").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    silent = w.filter("role = 'user'").select("conv_id").distinct().join(asked, "conv_id", "left").withColumn("cs", F.coalesce("cs", F.array().cast("array<string>")))
    found = w.filter("role = 'assistant'").join(silent, "conv_id").select("conv_id", "turn", C.found_in_text(F.col("cs"), F.col("w")).alias("f"))
    return found.select("conv_id", "turn", F.size("f").alias("n_found"), F.array_join("f", ",").alias("found"))


@query(f"WITH {TOPICS} SELECT source, coalesce(lang, '?') AS lang, count(*) AS n FROM topics GROUP BY ALL")
def merged_language_counts(spark, d):
    """Languages of a source: the counts of its two docsets, as maps, merged."""
    n = topics(spark, d).groupBy("source", "docset", F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"))
    maps = n.groupBy("source").pivot("docset", ["A", "B"]).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))))
    return maps.select("source", F.explode(S.merged(F.col("A"), F.col("B"))).alias("lang", "n"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SQL_STATS = ", ".join(f"avg({a}) AS m_{a}, coalesce(stddev_samp({a}), 0) AS s_{a}" for a in _NUMBERS)
_SQL_SCORE = " + ".join(f"CASE WHEN {a} IS NULL THEN 0 WHEN s_{a} > 0 THEN -ln(2 * pi() * s_{a}) / 2 - ({a} - m_{a}) * ({a} - m_{a}) / (2 * s_{a} * s_{a}) WHEN {a} = m_{a} THEN 0 ELSE '-inf'::DOUBLE END" for a in _NUMBERS)


@query(f"WITH m AS (SELECT l_returnflag AS label, count(*) AS n, {_SQL_STATS} FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) + count(*) AS t FROM m), x AS (SELECT row_number() OVER () AS i, * FROM lineitem), s AS (SELECT i, l_returnflag, label, ln((n + 1) / t) + {_SQL_SCORE} AS score FROM x, m, t), p AS (SELECT l_returnflag, label AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, label DESC) = 1) SELECT l_returnflag, predicted, count(*) AS n FROM p GROUP BY ALL")
def gaussian_bayes_flags(spark, d):
    """Flags of order lines against those that a continuous naive Bayes classifier fitted on them gives."""
    x = table(spark, d, "lineitem").select("l_returnflag", *_NUMBERS)
    return L.gaussian_bayes(x, x, list(_NUMBERS), "l_returnflag").groupBy("l_returnflag", "predicted").agg(F.count("*").alias("n"))

"""Joins, set operations, distributions in the log domain, tokenizers and small text tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions import tokenizers as K
from brevis.operators import joins as J
from brevis.operators import learning as L
from brevis.operators import probability as P
from brevis.operators import statistics as S
from brevis.sources.tables import table, topic_sentences

from .registry import SENTS, grams, no_stop, query
from .statistics_queries import _FREQ, _W, _halves, _words

_AB = f"{_W}, s AS (SELECT split_part(topic_id, '-', 1) AS source, docset, word FROM w), c AS (SELECT source, docset, word, count(*) AS c FROM s GROUP BY ALL), p AS (SELECT source, docset, word, c / sum(c) OVER (PARTITION BY source, docset) AS p FROM c), a AS (SELECT * FROM p WHERE docset = 'A'), b AS (SELECT * FROM p WHERE docset = 'B')"


def _counts(spark, d):
    return S.freq_dist(_words(spark, d), "topic_id", "word")


@query(f"WITH {SENTS}, g AS (SELECT topic_id, ord, unnest({grams('tok', 2)}) AS concept FROM sent) SELECT DISTINCT topic_id, concept FROM g WHERE ord > 0 AND (topic_id, concept) NOT IN (SELECT topic_id, concept FROM g WHERE ord = 0)")
def concepts_not_leading(spark, d):
    """Left anti join: concepts of a topic that no first sentence has."""
    g = topic_sentences(spark, d).select("topic_id", "ord", F.explode(T.ngrams(F.col("tok"), 2)).alias("concept"))
    return g.filter("ord > 0").select("topic_id", "concept").distinct().join(g.filter("ord = 0"), ["topic_id", "concept"], "left_anti")


@query("WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM benchmark), b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS position FROM pages) SELECT position, item_id, page_id FROM a JOIN b USING (position)")
def zip_by_position(spark, d):
    return J.zipped(table(spark, d, "benchmark").select("item_id"), "item_id", table(spark, d, "pages").select("page_id"), "page_id")


@query("WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT c.event_id, arg_min(p.event_id, (p.ts, p.event_id)) AS nearest FROM c LEFT JOIN p ON p.user_id = c.user_id AND (p.ts, p.event_id) > (c.ts, c.event_id) GROUP BY 1")
def nearest_purchase(spark, d):
    e = table(spark, d, "events")
    return J.nearest_after(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id").select("event_id", "nearest")


@query("WITH s AS (SELECT DISTINCT source FROM documents), n AS (SELECT DISTINCT source || '-' || lang AS name FROM documents) SELECT name, source FROM n JOIN s ON starts_with(name, source)")
def prefix_join_names(spark, d):
    docs = table(spark, d, "documents")
    return J.prefix_join(docs.select(F.concat_ws("-", "source", "lang").alias("name")).filter("contains(name, '-')").distinct(), "name", docs.select("source").distinct(), "source")


@query(f"WITH {SENTS}, w AS (SELECT doc_id, ord, list_distinct({no_stop('tok')}) AS w FROM sent), k AS (SELECT doc_id, ord, len(w) AS n, unnest(w) AS word FROM w), m AS (SELECT a.doc_id, a.ord AS a, b.ord AS b, count(*) AS shared, any_value(greatest(a.n, b.n)) AS top FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.word = b.word AND a.ord < b.ord GROUP BY ALL) SELECT doc_id, a, b, round(shared / top, 9) AS sim FROM m WHERE shared / top >= 0.5")
def similar_sentence_pairs(spark, d):
    """All pairs i < j of a document's sentences that share half of their words."""
    s = topic_sentences(spark, d).withColumn("w", T.without_stopwords(F.col("tok"), T.stopwords()))
    return J.similar_pairs(s, "doc_id", "ord", "w", 0.5).withColumn("sim", F.round("sim", 9))


@query(f"WITH {_W}, a AS (SELECT DISTINCT split_part(topic_id, '-', 1) AS source, word FROM w WHERE docset = 'A'), b AS (SELECT DISTINCT split_part(topic_id, '-', 1) AS source, word FROM w WHERE docset = 'B') SELECT source, word FROM a EXCEPT SELECT source, word FROM b")
def words_only_in_a(spark, d):
    w = _words(spark, d).select(F.split_part("topic_id", F.lit("-"), F.lit(1)).alias("source"), F.split_part("topic_id", F.lit("-"), F.lit(2)).alias("docset"), "word")
    return w.filter("docset = 'A'").select("source", "word").subtract(w.filter("docset = 'B'").select("source", "word"))


@query(f"WITH {SENTS} SELECT doc_id, ord, orig FROM sent WHERE ord < 3")
def leading_sentences(spark, d):
    """The first three sentences of a document, in input order: the limit is the operator."""
    return topic_sentences(spark, d).filter("ord < 3").select("doc_id", "ord", "orig")


@query(f"WITH {_FREQ}, m AS (SELECT topic_id, min(c) AS low FROM c GROUP BY 1) SELECT topic_id, word, c FROM c JOIN m USING (topic_id) WHERE c = low")
def argmin_word(spark, d):
    return P.argmin(_counts(spark, d), "topic_id", "word", "c")


@query(f"WITH {_AB}, x AS (SELECT a.source, sum(a.p * log2(a.p / coalesce(b.p, 1e-13))) AS kl FROM a LEFT JOIN b ON a.source = b.source AND a.word = b.word GROUP BY a.source), y AS (SELECT b.source, sum(b.p * log2(b.p / coalesce(a.p, 1e-13))) AS kl FROM b LEFT JOIN a ON a.source = b.source AND a.word = b.word GROUP BY b.source) SELECT x.source, round(x.kl + y.kl, 6) AS kl FROM x JOIN y USING (source)")
def symmetric_kl(spark, d):
    a, b = _halves(spark, d)
    return P.symmetric_kl(a, b, "source", "word").withColumn("kl", F.round("kl", 6))


@query(f"WITH {_FREQ} SELECT topic_id, word, round(log2(c / n), 9) AS logp FROM c JOIN n USING (topic_id)")
def log_probabilities(spark, d):
    return P.log_domain(S.smoothed(_counts(spark, d), ("topic_id",), "mle")).select("topic_id", "word", F.round("logp", 9).alias("logp"))


@query(f"WITH {_FREQ}, l AS (SELECT topic_id, log2(c / n) AS logp FROM c JOIN n USING (topic_id) WHERE c > 1) SELECT topic_id, round(log2(sum(pow(2, logp))), 6) AS total FROM l GROUP BY topic_id")
def sum_of_logs(spark, d):
    """The mass of words seen twice or more, added up in the log domain."""
    p = P.log_domain(S.smoothed(_counts(spark, d), ("topic_id",), "mle")).filter("c > 1")
    return P.sum_logs(p, "topic_id", "logp").withColumn("total", F.round("total", 6))


@query("SELECT l_orderkey, l_linenumber, round(log2(l_quantity + l_extendedprice), 9) AS total FROM lineitem")
def add_two_logs(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.add_logs(F.log2("l_quantity"), F.log2("l_extendedprice")), 9).alias("total"))


@query(f"WITH {_FREQ} SELECT topic_id, round(sum(c * log2(c / n)), 4) AS ll FROM c JOIN n USING (topic_id) GROUP BY topic_id")
def log_likelihood(spark, d):
    p = P.log_domain(S.smoothed(_counts(spark, d), ("topic_id",), "mle"))
    return p.groupBy("topic_id").agg(F.round(F.sum(F.col("c") * F.col("logp")), 4).alias("ll"))


@query(f"WITH {_FREQ}, h AS (SELECT topic_id, word, sum(c) OVER (PARTITION BY topic_id ORDER BY word ROWS UNBOUNDED PRECEDING) AS hi, c, sum(c) OVER (PARTITION BY topic_id) AS t FROM c) SELECT topic_id, u, word FROM h, (VALUES (0.125), (0.5), (0.875)) v(u) WHERE u::DOUBLE >= (hi - c) / t AND u::DOUBLE < hi / t")
def sampled_words(spark, d):
    s = P.sampled(_counts(spark, d), "topic_id", "word", [0.125, 0.5, 0.875])
    return s.select("topic_id", F.col("u").cast("decimal(4,3)").alias("u"), "word")


@query(f"WITH {_FREQ} SELECT topic_id, word, round(1.0::DOUBLE / b, 12) AS p FROM c JOIN n USING (topic_id)")
def uniform_distribution(spark, d):
    return P.uniform(_counts(spark, d), "topic_id", "word").withColumn("p", F.round("p", 12))


@query(f"WITH {_W}, h AS (SELECT word, count(CASE WHEN doc_id % 2 = 0 THEN 1 END) AS a, count(CASE WHEN doc_id % 2 = 1 THEN 1 END) AS b FROM w GROUP BY 1), t AS (SELECT 0 AS way, a AS r, b AS o FROM h UNION ALL SELECT 1, b, a FROM h), n AS (SELECT way, sum(o) AS n FROM t GROUP BY 1), e AS (SELECT way, r, count(*) AS nr, sum(o) AS o FROM t WHERE r > 0 GROUP BY ALL) SELECT r, round(sum(o / (nr * n)) / 2, 12) AS p FROM e JOIN n USING (way) GROUP BY r")
def cross_validation_estimate(spark, d):
    half = F.col("doc_id") % 2
    c = _words(spark, d).groupBy("word").agg(F.count_if(half == 0).alias("a"), F.count_if(half == 1).alias("b"))
    return P.cross_validated(c, "word").withColumn("p", F.round("p", 12))


@query(f"WITH {_FREQ} SELECT topic_id || '.' || word AS key, c FROM c")
def flattened_counts(spark, d):
    return P.flattened(_counts(spark, d), "topic_id", "word")


@query("WITH p AS (SELECT n_regionkey AS a, n_nationkey AS b FROM nation) SELECT a, b FROM p UNION SELECT b, a FROM p")
def symmetric_closure(spark, d):
    return P.symmetric_closure(table(spark, d, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b")))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ' ') AS langs FROM documents WHERE lang IS NOT NULL GROUP BY source HAVING count(DISTINCT lang) > 1")
def minimal_sets(spark, d):
    m = P.minimal_sets(table(spark, d, "documents").filter("lang is not null"), "source", "lang")
    return m.select("source", F.array_join("targets", " ").alias("langs"))


@query("SELECT word, count(*) AS n_keys, min(doc_id) AS first_key FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS word FROM documents) GROUP BY word")
def inverted_dictionary(spark, d):
    """word -> the documents that have it, as their number and the first: lists of all would grow without bound."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(K.words_only(F.col("text")))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n_keys"), F.min("doc_id").alias("first_key"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS by_whitespace, len(string_split(text, ' '))::BIGINT AS by_space, len(string_split(text, chr(9)))::BIGINT AS by_tab,
len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''))::BIGINT AS by_line, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*\n[ \t\n\x0B\f\r]*'), lambda x: x <> ''))::BIGINT AS by_blank_line,
len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]+'))::BIGINT AS word_punctuation, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS words_only FROM documents""")
def tokenizer_counts(spark, d):
    kinds = (K.by_whitespace, K.by_space, K.by_tab, K.by_line, K.by_blank_line, K.word_punctuation, K.words_only)
    return table(spark, d, "documents").select("doc_id", *[F.size(f(F.col("text"))).cast("long").alias(f.__name__) for f in kinds])


@query(f"WITH {SENTS} SELECT word, CASE WHEN len(word) >= 4 THEN regexp_replace(word, 'ing$|s$|e$|able$', '', 'g') ELSE word END AS stem, count(*) AS n FROM (SELECT unnest(tok) AS word FROM sent) GROUP BY ALL")
def regexp_stems(spark, d):
    w = topic_sentences(spark, d).select(F.explode("tok").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", K.regexp_stem(F.col("word")).alias("stem"), "n")


@query(r"SELECT doc_id, regexp_replace(text, '[aeiou]+', '*') AS first_only, regexp_replace(text, '([0-9]+)', '{\1}', 'g') AS shown FROM documents")
def regexp_tools(spark, d):
    return table(spark, d, "documents").select("doc_id", K.first_replaced(F.col("text"), "[aeiou]+", "*").alias("first_only"), K.shown(F.col("text"), "[0-9]+").alias("shown"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '^[^/@]*@', ''), '^([^/:]*):[0-9]+', '\1'), '^www[.]', ''), '/$', '') AS cleaned FROM pages")
def clean_urls(spark, d):
    return table(spark, d, "pages").select("page_id", K.clean_url(F.col("url")).alias("cleaned"))


@query(f"WITH {SENTS}, w AS (SELECT topic_id, list_filter(tok, lambda x: regexp_matches(x, '[a-zA-Z0-9]')) AS w FROM sent) SELECT topic_id, gram, count(*) AS c FROM (SELECT topic_id, unnest({grams('w', 2)}) AS gram FROM w) GROUP BY ALL")
def alnum_bigram_counts(spark, d):
    return topic_sentences(spark, d).select("topic_id", F.explode(K.alnum_bigrams(F.col("tok"))).alias("gram")).groupBy("topic_id", "gram").agg(F.count("*").alias("c"))


_PHRASES = ("yesterday", "today", "tomorrow", "last week", "next week", "last month", "next month", "last year", "next year", "monday", "friday", "last sunday", "next tuesday", "1999-12-31", "someday")


@query("WITH o AS (SELECT DISTINCT o_orderdate::DATE AS o FROM orders), x AS (SELECT o AS anchor, p AS phrase, isodow(o) AS now, list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], list_last(string_split(p, ' '))) AS day FROM o, (VALUES " + ", ".join(f"('{p}')" for p in _PHRASES) + ") v(p)) "
       "SELECT anchor, phrase, CASE WHEN phrase = '1999-12-31' THEN DATE '1999-12-31' WHEN phrase = 'yesterday' THEN anchor - 1 WHEN phrase = 'today' THEN anchor WHEN phrase = 'tomorrow' THEN anchor + 1 WHEN phrase = 'last week' THEN anchor - 7 WHEN phrase = 'next week' THEN anchor + 7 "
       "WHEN phrase = 'last month' THEN (anchor - INTERVAL 1 MONTH)::DATE WHEN phrase = 'next month' THEN (anchor + INTERVAL 1 MONTH)::DATE WHEN phrase = 'last year' THEN (anchor - INTERVAL 12 MONTH)::DATE WHEN phrase = 'next year' THEN (anchor + INTERVAL 12 MONTH)::DATE "
       "WHEN day > 0 AND phrase LIKE 'last %' THEN (anchor - (CASE WHEN day < now THEN now - day ELSE now - day + 7 END)::INT)::DATE WHEN day > 0 THEN (anchor + (CASE WHEN day > now THEN day - now ELSE day - now + 7 END)::INT)::DATE END AS meant FROM x")
def grounded_dates(spark, d):
    """What relative time expressions mean on each order date."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("anchor")).distinct()
    return o.withColumn("phrase", F.explode(F.array(*map(F.lit, _PHRASES)))).withColumn("meant", K.grounded(F.col("phrase"), F.col("anchor")))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS f FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: pow(e[i] - f[i], 2)))), 6) AS euclidean, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS cosine FROM v WHERE f IS NOT NULL")
def vector_distances(spark, d):
    """Euclidean distance and cosine similarity of each vector and the next one."""
    rows = L.ranked(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "vec_id")
    nxt = rows.select((F.col("rank") - 1).alias("rank"), F.col("e").alias("f"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    gap = F.sqrt(total(F.zip_with("e", "f", lambda x, y: (x - y) * (x - y))))
    return rows.join(nxt, "rank").select("vec_id", F.round(gap, 6).alias("euclidean"), F.round(dot("e", "f") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("f", "f"))), 6).alias("cosine"))

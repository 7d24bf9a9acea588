"""Scalar text operators over documents, pages and their sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.sources.tables import sentences, table, topic_sentences, topics

from .registry import SENTS, SPLIT, all_stop, fixed, grams, no_stop, punct_free, query, skips, tokens, words_of


def _sents(spark, d):
    return topic_sentences(spark, d)


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def remove_tags_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.remove_tags(F.col("html")).alias("plain"))


@query(None)
def clean_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("plain"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/:?#]+)", 1).alias("host"), F.regexp_extract(u, "://[^/]+(/[^?#]*)", 1).alias("path"))


@query(f"SELECT doc_id, {punct_free('text')} AS plain FROM documents")
def remove_punct_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_punct(F.col("text")).alias("plain"))


@query(f"WITH {SENTS} SELECT doc_id, ord, NOT regexp_matches(orig, '[a-zA-Z0-9]') AS punct FROM sent")
def is_punct_sentences(spark, d):
    return _sents(spark, d).select("doc_id", "ord", T.is_punct(F.col("orig")).alias("punct"))


@query(f"SELECT doc_id, {fixed('text')} AS plain FROM documents")
def fix_text_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fix_text(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS toks FROM documents")
def tokenize_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("toks"))


@query(f"SELECT doc_id, unnest({SPLIT}) AS sentence FROM documents")
def sentence_split_simple(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("sentence"))


@query(f"WITH {SENTS} SELECT topic_id, doc_id, ord, length, len(tok)::INT AS n_tok FROM sent")
def sentence_positions(spark, d):
    return _sents(spark, d).select("topic_id", "doc_id", "ord", "length", F.size("tok").alias("n_tok"))


@query(f"WITH {SENTS} SELECT doc_id, count(*) AS n_sentences, arg_min(orig, ord) AS first_sentence, arg_max(orig, ord) AS last_sentence FROM sent GROUP BY doc_id")
def first_last_sentence(spark, d):
    return _sents(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.min_by("orig", "ord").alias("first_sentence"), F.max_by("orig", "ord").alias("last_sentence"))


def _grams(n):
    sql = f"WITH {SENTS}, g AS (SELECT topic_id, unnest({grams('tok', n)}) AS gram FROM sent) SELECT topic_id, gram, count(*) AS c FROM g GROUP BY ALL"

    def f(spark, d):
        return _sents(spark, d).select("topic_id", F.explode(T.ngrams(F.col("tok"), n)).alias("gram")).groupBy("topic_id", "gram").agg(F.count("*").alias("c"))

    f.__name__ = {1: "ngram_uni", 2: "ngram_bi", 3: "ngram_tri", 4: "ngram_four"}[n]
    return query(sql)(f)


for _n in (1, 2, 3, 4):
    _grams(_n)


@query(f"WITH {SENTS}, w AS (SELECT topic_id, doc_id, list_concat(list_concat(['<start>'], tok), ['<end>']) AS b FROM sent WHERE ord = 0) SELECT topic_id, doc_id, array_to_string({grams('b', 2)}, ' ') AS marked FROM w")
def ngram_bounds(spark, d):
    return _sents(spark, d).filter("ord = 0").select("topic_id", "doc_id", F.array_join(T.ngrams(F.col("tok"), 2, bounds=True), " ").alias("marked"))


@query(f"WITH {SENTS}, s AS (SELECT doc_id, ord, len(list_distinct({skips('tok')}))::INT AS n_pairs FROM sent) SELECT doc_id, sum(n_pairs)::BIGINT AS n_pairs FROM s GROUP BY doc_id")
def skip_bigrams_k4(spark, d):
    return _sents(spark, d).select("doc_id", F.size(T.skip_bigrams(F.col("tok"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_pairs"))


@query(f"WITH {SENTS}, s AS (SELECT doc_id, len(list_distinct(list_concat({skips('tok')}, tok)))::INT AS n FROM sent) SELECT doc_id, sum(n)::BIGINT AS n_units FROM s GROUP BY doc_id")
def units_su4(spark, d):
    return _sents(spark, d).select("doc_id", F.size(T.skip_units(F.col("tok"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_units"))


@query(f"WITH {SENTS} SELECT doc_id, ord, array_to_string({no_stop('tok')}, ' ') AS content FROM sent")
def stopword_filter(spark, d):
    return _sents(spark, d).select("doc_id", "ord", F.array_join(T.without_stopwords(F.col("tok"), T.stopwords()), " ").alias("content"))


@query(f"WITH {SENTS}, g AS (SELECT unnest({grams('tok', 2)}) AS gram FROM sent) SELECT gram, count(*) AS c FROM g WHERE {all_stop('''string_split(gram, '_')''')} GROUP BY gram")
def all_stopword_bigrams(spark, d):
    g = _sents(spark, d).select(F.explode(T.ngrams(F.col("tok"), 2)).alias("gram"))
    return g.filter(T.just_stopwords(F.split("gram", "_"), T.stopwords())).groupBy("gram").agg(F.count("*").alias("c"))


@query(f"WITH {SENTS}, p AS (SELECT doc_id, ord, {no_stop('tok')} AS a, lead({no_stop('tok')}) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM sent) "
       "SELECT doc_id, ord, round(len(list_intersect(list_distinct(a), list_distinct(b))) / nullif(greatest(len(list_distinct(a)), len(list_distinct(b))), 0), 9) AS sim FROM p WHERE b IS NOT NULL")
def sim_adjacent_sentences(spark, d):
    from pyspark.sql import Window as W

    s = _sents(spark, d).withColumn("a", T.without_stopwords(F.col("tok"), T.stopwords()))
    s = s.withColumn("b", F.lead("a").over(W.partitionBy("doc_id").orderBy("ord")))
    return s.filter("b is not null").select("doc_id", "ord", F.round(T.overlap_similarity(F.col("a"), F.col("b")), 9).alias("sim"))


@query(f"WITH {SENTS}, k AS (SELECT regexp_replace(replace(replace(lower(w), 'z', 's'), 'h', ''), 'e+$', '') AS key, w FROM (SELECT unnest(tok) AS w FROM sent)) SELECT key, count(*) AS n, count(DISTINCT w) AS spellings, min(w) AS example FROM k GROUP BY key")
def spelling_keys(spark, d):
    w = _sents(spark, d).select(F.explode("tok").alias("w"))
    key = F.regexp_replace(F.replace(F.replace(F.lower("w"), F.lit("z"), F.lit("s")), F.lit("h"), F.lit("")), "e+$", "")
    return w.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("spellings"), F.min("w").alias("example"))


#: Words that the entailment tagger leaves out.
BOW_STOP = ("a", "the", "it", "they", "of", "in", "have", "is", "are", "were", "and")
_BOW = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+')), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in BOW_STOP) + "))"


@query(f"SELECT conv_id, turn, round(100.0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score, 100.0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 33 AS entails FROM "
       f"(SELECT t.conv_id, t.turn, {_BOW.format("t.text")} AS a, {_BOW.format("n.text")} AS b FROM conversations t JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1) WHERE len(list_distinct(list_concat(a, b))) > 0")
def entailment_bag_of_words(spark, d):
    c = table(spark, d, "conversations")
    words = lambda x: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]+"), F.lit(0))), lambda w: ~w.isin(*BOW_STOP))
    a = c.select("conv_id", "turn", words(F.col("text")).alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), words(F.col("text")).alias("b"))
    score = 100 * T.jaccard(F.col("a"), F.col("b"))
    return a.join(b, ["conv_id", "turn"]).filter(F.size(F.array_union("a", "b")) > 0).select("conv_id", "turn", F.round(score, 6).alias("score"), (score >= 33).alias("entails"))


@query(f"WITH {SENTS}, k AS (SELECT doc_id, ord, tok, unnest(range(1, len(tok) + 1)) AS i FROM sent) SELECT doc_id, ord, i::INT AS at, array_to_string(tok[greatest(1, i - 3):i - 1], ' ') AS left_context, tok[i] AS word, array_to_string(tok[i + 1:i + 3], ' ') AS right_context FROM k WHERE tok[i] = 'with'")
def kwic(spark, d):
    k = _sents(spark, d).select("doc_id", "ord", "tok", F.posexplode("tok").alias("p", "word")).filter("word = 'with'")
    left = F.array_join(F.slice("tok", F.greatest(F.lit(1), F.col("p") - 2), F.least(F.lit(3), F.col("p"))), " ")
    return k.select("doc_id", "ord", (F.col("p") + 1).alias("at"), left.alias("left_context"), "word", F.array_join(F.slice("tok", F.col("p") + 2, F.lit(3)), " ").alias("right_context"))



@query(f"""WITH w AS (SELECT doc_id, {words_of('text')} AS ws, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS n_sent, len(regexp_extract_all(text, '[a-zA-Z0-9]')) AS chars FROM documents),
c AS (SELECT doc_id, len(ws) AS n, n_sent, chars, len(list_filter(ws, lambda x: len(x) >= 7)) AS long_words, list_sum(list_transform(ws, lambda x: len(regexp_extract_all(lower(x), '[aeiouy]+')))) AS syll, len(list_filter(ws, lambda x: len(regexp_extract_all(lower(x), '[aeiouy]+')) >= 3)) AS complex FROM w)
SELECT doc_id, round(n / n_sent + 100.0 * long_words / n, 9) AS lix, round(long_words / n_sent, 9) AS rix, round(4.71 * chars / n + 0.5 * (n // n_sent) - 21.43, 9) AS ari, round(206.835 - 1.015 * (n // n_sent) - 84.6 * syll / n, 9) AS flesch, round(0.39 * (n // n_sent) + 11.8 * syll / n - 15.59, 9) AS kincaid, round(0.4 * ((n // n_sent) + 100.0 * complex / n), 9) AS fog, round(3 + sqrt(complex * 30.0 / n_sent), 9) AS smog, round(5.89 * chars / n - 30.0 * n_sent / n - 15.8, 9) AS coleman FROM c WHERE n > 0""")
def readability_scores(spark, d):
    ws = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    syll = lambda w: F.regexp_count(F.lower(w), F.lit("[aeiouy]+"))
    x = table(spark, d, "documents").select("doc_id", ws.alias("ws"), F.greatest(F.regexp_count("text", F.lit("[.!?]+")), F.lit(1)).alias("n_sent"), F.regexp_count("text", F.lit("[a-zA-Z0-9]")).alias("chars"))
    x = x.select("doc_id", "n_sent", "chars", F.size("ws").alias("n"), F.size(F.filter("ws", lambda w: F.length(w) >= 7)).alias("lw"), F.transform("ws", syll).alias("s")).filter("n > 0")
    x = x.withColumn("syll", F.aggregate("s", F.lit(0), lambda a, v: a + v)).withColumn("hard", F.size(F.filter("s", lambda v: v >= 3))).withColumn("per", F.floor(F.col("n") / F.col("n_sent")))
    n, s, c, per = F.col("n"), F.col("n_sent"), F.col("chars"), F.col("per")
    r = lambda v, name: F.round(v, 9).alias(name)
    return x.select("doc_id", r(n / s + 100.0 * F.col("lw") / n, "lix"), r(F.col("lw") / s, "rix"), r(4.71 * c / n + 0.5 * per - 21.43, "ari"), r(206.835 - 1.015 * per - 84.6 * F.col("syll") / n, "flesch"), r(0.39 * per + 11.8 * F.col("syll") / n - 15.59, "kincaid"), r(0.4 * (per + 100.0 * F.col("hard") / n), "fog"), r(3 + F.sqrt(F.col("hard") * 30.0 / s), "smog"), r(5.89 * c / n - 30.0 * s / n - 15.8, "coleman"))


@query("SELECT item_id, levenshtein(left_, right_) AS distance FROM (SELECT item_id, array_to_string(string_split(x, ' ')[1:4], ' ') AS left_, array_to_string(string_split(x, ' ')[5:8], ' ') AS right_ FROM (SELECT item_id, " + fixed("text") + " AS x FROM benchmark))")
def edit_distance_phrases(spark, d):
    w = F.split(T.fix_text(F.col("text")), " ")
    return table(spark, d, "benchmark").select("item_id", F.levenshtein(F.array_join(F.slice(w, 1, 4), " "), F.array_join(F.slice(w, 5, 4), " ")).cast("long").alias("distance"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CLEANING = f"""a AS (SELECT doc_id, ord, orig, regexp_replace(regexp_replace(regexp_replace(orig, {_sql_text(T.DAY_PHRASE)}, '\\5', 'gi'), '^, ([0-9A-Za-z_])', '\\1'), '\\s+', ' ', 'g') AS x FROM sent),
b AS (SELECT doc_id, ord, orig, CASE WHEN len({words_of('x')}) > 10 THEN regexp_replace(x, {_sql_text(T.SAID)}, '.', 'gi') ELSE x END AS x FROM a),
c AS (SELECT doc_id, ord, orig, trim(regexp_replace(regexp_replace(regexp_replace(x, {_sql_text(T.OPENING_MARKERS)}, '', 'i'), {_sql_text(T.CONJUNCTIONS)}, '', 'i'), {_sql_text(T.INNER_MARKERS)}, '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM b),
cleaned AS (SELECT doc_id, ord, CASE WHEN len({words_of('orig')}) <= 8 THEN orig WHEN starts_with(x, '"') THEN '"' || translate(x[2:2], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || x[3:] ELSE translate(x[1:1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || x[2:] END AS cleaned FROM c)"""

_CLEAN = f"{SENTS}, {CLEANING}"


@query(f"WITH {_CLEAN} SELECT doc_id, ord, cleaned FROM cleaned")
def clean_sentences(spark, d):
    return _sents(spark, d).select("doc_id", "ord", T.clean_sentence(F.col("orig")).alias("cleaned"))


_WORDS = words_of("cleaned")
_CLAUSE, _BEFORE = words_of("list_last(string_split(cleaned, ','))"), words_of("array_to_string(string_split(cleaned, ',')[1:-2], ' ')")


AGGRESSIVE = f"""CASE WHEN lower({_WORDS}[1]) IN ('as', 'if', 'since', 'asked') OR lower({_CLAUSE}[1]) IN ('and', 'but', 'although', 'or') OR len({_CLAUSE}) >= len({_BEFORE}) OR len({_CLAUSE}) = 0 OR len({_WORDS}) = 0 THEN cleaned ELSE regexp_replace(cleaned, {_sql_text(T.TOLD)}, '.', 'gi') END"""


@query(f"WITH {_CLEAN} SELECT doc_id, ord, {AGGRESSIVE} AS cleaned FROM cleaned")
def clean_sentences_aggressive(spark, d):
    return _sents(spark, d).select("doc_id", "ord", T.clean_aggressive(F.col("orig")).alias("cleaned"))


@query(None)
def date_expressions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.date_mentions(F.col("text"))).alias("mention"))

"""The registry that query modules fill, and SQL fragments that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brevis.functions.text import stopwords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in stopwords())
_BLANKS = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"

#: The same rules as brevis.functions.text, for DuckDB.
SPLIT = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '')"


def words_of(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


def punct_free(s: str) -> str:
    return f"trim(regexp_replace({s}, '[^a-zA-Z0-9\\- ]', '', 'g'))"


def fixed(s: str) -> str:
    return f"lower(regexp_replace({punct_free(s)}, ' +', ' ', 'g'))"


def word_tokens(s: str) -> str:
    lead = lambda x: f"regexp_replace({x}, '((^| )-)([^-])', '\\1 \\3', 'g')"
    return f"list_filter(regexp_split_to_array(regexp_replace({lead(lead(s))}, '([^-])(--+)([^-])', '\\1 \\2 \\3', 'g'), ' +'), lambda w: w <> '')"


def tokens(s: str) -> str:
    return word_tokens(fixed(s))


def grams(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], '_'))"


def skips(w: str, gap: int = 4) -> str:
    return f"flatten(list_transform(range(1, len({w}) + 1), lambda i: list_transform({w}[i + 1:i + {gap + 1}], lambda y: {w}[i] || '_' || y)))"


def no_stop(w: str) -> str:
    return f"list_filter({w}, lambda x: x NOT IN ({STOP}))"


def all_stop(w: str) -> str:
    return f"(len(list_filter({w}, lambda x: x NOT IN ({STOP}))) = 0)"


TOPICS = "topics AS (SELECT source || CASE WHEN doc_id // 32 % 2 = 0 THEN '-A' ELSE '-B' END AS topic_id, source, CASE WHEN doc_id // 32 % 2 = 0 THEN 'A' ELSE 'B' END AS docset, doc_id, text, lang FROM documents)"
SENTS = f"""{TOPICS}, split AS (SELECT topic_id, docset, doc_id, {SPLIT} AS l FROM topics),
flat AS (SELECT topic_id, docset, doc_id, unnest(l) AS orig, unnest(range(0, len(l)))::INT AS ord FROM split),
sent AS (SELECT topic_id, docset, doc_id, ord, orig, {tokens('orig')} AS tok, len({words_of('orig')})::INT AS length FROM flat)"""
QUERIES_CTE = f"queries AS (SELECT DISTINCT topic_id, b.text AS query, list_distinct({no_stop(tokens('b.text'))}) AS q FROM topics t JOIN benchmark b ON b.item_id = regexp_extract(t.source, '([0-9]+)$', 1)::BIGINT)"
OVER = f"{SENTS}, {QUERIES_CTE}, over_ AS (SELECT s.*, coalesce(len(list_intersect(list_distinct({no_stop('tok')}), q.q)), 0)::INT AS overlap FROM sent s LEFT JOIN queries q USING (topic_id))"
OCC = f"{OVER}, occ AS (SELECT DISTINCT topic_id, docset, doc_id, ord, overlap, unnest(list_distinct({grams('tok', 2)})) AS concept FROM over_)"


def production(docset: str, first: int, least: int, overlap: int) -> str:
    return f"""{OCC}, marks AS (SELECT topic_id, concept, count(DISTINCT (doc_id, ord = 0)) AS n_markers, count(DISTINCT CASE WHEN ord = 0 THEN doc_id END) AS n_first FROM occ WHERE docset = '{docset}' AND overlap >= {overlap} GROUP BY ALL),
weights AS (SELECT topic_id, concept, n_markers + {first} * n_first AS weight FROM marks WHERE n_markers + {first} * n_first >= {least} AND NOT {all_stop("string_split(concept, '_')")}),
able AS (SELECT *, row_number() OVER (PARTITION BY topic_id, array_to_string(tok, ' ') ORDER BY doc_id, ord) AS rn FROM over_ WHERE docset = '{docset}' AND length >= 10 AND NOT regexp_matches(orig, '^["(].*[")]$')),
cands AS (SELECT * FROM able WHERE rn = 1)"""

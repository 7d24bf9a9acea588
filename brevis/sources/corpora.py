"""Readers of topic files, newswire and annotated corpora, on Spark's text source.

Every reader takes a path or a DataFrame(path, value) of whole files, so that any
store Spark reads will do; parsing is on built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.functions import text as T


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, value), a row per file whose name matches the glob, at any depth."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _one(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(text, pattern, 1))


def topics_xml(files: DataFrame) -> DataFrame:
    """(topic_id, title, narr, docset, docset_at, doc_id, doc_pos) of <topic id> files whose docsets list <doc id>."""
    t = files.select(F.explode(_all(F.col("value"), "(?s)(<topic\\b.*?</topic>)")).alias("t"))
    head = t.select(_one(F.col("t"), "<topic[^>]*\\bid\\s*=\\s*\"([^\"]*)\"").alias("topic_id"), _one(F.col("t"), "(?s)<title>(.*?)</title>").alias("title"), _one(F.col("t"), "(?s)<narrative>(.*?)</narrative>").alias("narr"), F.posexplode(_all(F.col("t"), "(?s)(<docset.*?</docset[^>]*>)")).alias("docset_at", "d"))
    sets = head.select("topic_id", "title", "narr", "docset_at", _one(F.col("d"), "<docset[^>]*\\bid\\s*=\\s*\"([^\"]*)\"").alias("docset"), F.posexplode(_all(F.col("d"), "<doc\\b[^>]*\\bid\\s*=\\s*\"([^\"]*)\"")).alias("doc_pos", "doc_id"))
    return sets.select("topic_id", "title", "narr", "docset", "docset_at", "doc_id", "doc_pos")


def topics_sgml(files: DataFrame) -> DataFrame:
    """The same of <topic> files with <num>, <title>, <narr> and white-space separated <docs...>; docsets are named only where there are several."""
    t = files.select(F.explode(_all(F.col("value"), "(?is)(<topic>.*?</topic>)")).alias("t"))
    docs = F.filter(F.transform(_all(F.col("t"), "(?is)<docs[^>]*>(.*?)</docs"), F.trim), lambda x: x != "")
    head = t.select(F.regexp_replace(_one(F.col("t"), "(?is)<num>(.*?)</num>"), "(?i)number:|\\s", "").alias("topic_id"), _one(F.col("t"), "(?is)<title>(.*?)</title>").alias("title"), _one(F.col("t"), "(?is)<narr>(.*?)</narr>").alias("narr"), F.size(docs).alias("n"), F.posexplode(docs).alias("docset_at", "d"))
    name = F.when(F.col("n") > 1, F.concat("topic_id", F.lit("-"), F.chr(F.col("docset_at") + 65))).otherwise(F.col("topic_id"))
    return head.select("topic_id", "title", "narr", name.alias("docset"), "docset_at", F.posexplode(F.split("d", "\\s+")).alias("doc_pos", "doc_id"))


def earlier_documents(topic_docs: DataFrame) -> DataFrame:
    """(topic_id, docset, old_doc): the documents of a topic's earlier docsets."""
    now = topic_docs.select("topic_id", "docset", "docset_at").distinct()
    old = topic_docs.select("topic_id", F.col("docset_at").alias("before"), F.col("doc_id").alias("old_doc"))
    return now.join(old, "topic_id").filter("before < docset_at").select("topic_id", "docset", "old_doc")


def newswire(files: DataFrame) -> DataFrame:
    """(doc_id, source, date_key, paragraphs) of <DOC> files: the id comes from the first 100 characters, source is its leading part without digits or _."""
    head = F.substring("value", 1, 100)
    doc_id = F.coalesce(F.nullif(F.trim(F.regexp_extract(head, "<DOCNO>([^<]*)</DOCNO>", 1)), F.lit("")), F.nullif(F.regexp_extract(head, "(?i)<DOC[^>]*\\bid\\s*=\\s*\"([^\"]*)\"", 1), F.lit("")))
    text = F.regexp_extract("value", "(?is)<text>(.*?)(</text>|\\z)", 1)
    text = F.regexp_replace(F.regexp_replace(text, "``|''|&quot;", '"'), "&amp;", "&")
    pars = F.split(F.regexp_replace(text, "(?i)</?(p|text|doc)>", "\u0001"), "\u0001")
    pars = F.filter(F.transform(pars, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " "))), lambda x: x != "")
    out = files.select(doc_id.alias("doc_id"), F.transform(pars, fix_paragraph).alias("paragraphs"))
    source = F.regexp_extract("doc_id", "^[^_0-9]*", 0)
    return out.select("doc_id", source.alias("source"), F.expr("substr(doc_id, length(regexp_extract(doc_id, '^[^_0-9]*', 0)) + 1)").alias("date_key"), "paragraphs")


def fix_paragraph(p: Column) -> Column:
    """Datelines out, dashes to commas, no space before a comma, a space after a period between words."""
    x = F.regexp_replace(p, "^[A-Z][A-Z .,'-]{2,60}( \\([A-Za-z ]+\\))? (--|_) ", "")
    x = F.regexp_replace(x, " (--|_) ", ", ")
    x = F.regexp_replace(x, " +,", ",")
    return F.regexp_replace(x, "([a-z])\\.([A-Z])", "$1. $2")


def gold_summaries(files: DataFrame) -> DataFrame:
    """(topic_id, annotator, line_no, text) from files named topic.M.length.annotator...; the name's parts are dot separated."""
    name = F.split(F.element_at(F.split("path", "/"), -1), "\\.")
    lines = files.select(F.get(name, F.lit(0)).alias("topic_id"), F.element_at(name, -1).alias("annotator"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))
    return lines.filter("trim(text) <> ''")


def tagged(files: DataFrame, separator: str = "/") -> DataFrame:
    """(path, line, at, word, tag) of word/tag text; the last separator counts."""
    t = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "s")).select("path", "line", F.posexplode(F.filter(F.split("s", "\\s+"), lambda x: x != "")).alias("at", "t"))
    return t.select("path", "line", "at", F.substring_index("t", separator, 1).alias("word") if separator != "/" else F.regexp_replace("t", "/[^/]*$", "").alias("word"), F.substring_index("t", separator, -1).alias("tag"))


def conll(files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(path, sentence, tok_id, columns...) of blank-line separated sentences of tab-separated tokens."""
    s = files.select("path", F.posexplode(F.split("value", "\r?\n[ \\t]*\r?\n")).alias("sentence", "b"))
    rows = s.select("path", "sentence", F.posexplode(F.filter(F.split("b", "\r?\n"), lambda x: F.trim(x) != "")).alias("at", "r")).withColumn("f", F.split("r", "\t"))
    return rows.select("path", "sentence", (F.col("at") + 1).alias("tok_id"), *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def xml_elements(files: DataFrame, tag: str) -> DataFrame:
    """(path, at, body) of an element's occurrences."""
    return files.select("path", F.posexplode(_all(F.col("value"), f"(?s)<{tag}\\b[^>]*>(.*?)</{tag}>")).alias("at", "body"))


def word_list(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.split("value", "\r?\n")).alias("word")).filter("word <> ''")


def column_rows(sents: DataFrame) -> DataFrame:
    """(topic_id, doc_id, ord, text) to dump: sentences that start with two small letters are bad splits and go; a document's first sentence is cleaned harder than others."""
    start = F.substring("orig", 1, 2)
    good = ~((start == F.lower(start)) & (start != F.upper(start)))
    text = F.when(F.col("ord") == 0, T.clean_aggressive(F.col("orig"))).otherwise(T.clean_sentence(F.col("orig")))
    return sents.filter(good).select("topic_id", "doc_id", "ord", text.alias("text"))


def write_columns(rows: DataFrame, path: str) -> None:
    """Dumped sentences, a folder a topic."""
    rows.write.mode("overwrite").partitionBy("topic_id").parquet(path)


def renumbered(rows: DataFrame) -> DataFrame:
    """Sentences as loaded from a dump: ord counts the sentences of a document that were dumped, from 0."""
    w = W.partitionBy("topic_id", "doc_id").orderBy("ord")
    return rows.select("topic_id", "doc_id", (F.row_number().over(w) - 1).alias("ord"), "text")


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """What write_columns wrote, renumbered."""
    return renumbered(spark.read.schema("doc_id long, ord int, text string, topic_id string").parquet(path))


def loaded(problems: DataFrame, checks: list[str]) -> DataFrame:
    """One row: whether every problem has each of its parts; a null flag is a missing part, no problems have all."""
    return problems.agg(*[F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(c) for c in checks])


def write_summaries(summaries: DataFrame, path: str) -> None:
    """A text file of lines per topic, in order."""
    lines = summaries.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "text"))), lambda x: x["text"]), "\n").alias("value"))
    lines.write.mode("overwrite").partitionBy("topic_id").text(path)

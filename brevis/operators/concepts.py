"""Concept extraction, weighting and candidate sentences.

sents: (topic_id, doc_id, ord, orig, words, length). Everything is grouped by
(topic_id, concept) with map-side combining, so a large topic doesn't meet in one task;
what has one row a topic is broadcast, since a join by topic would bring its sentences together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.stem import stem_arrays
from brevis.sources.scratch import stored


@dataclass(frozen=True)
class Rule:
    """first: extra weight of a document whose first sentence has the concept; least: smallest weight that is kept; overlap: query words a sentence needs."""

    first: int
    least: int
    overlap: int


#: Production rules by docset.
RULES = {"A": Rule(1, 3, 1), "B": Rule(2, 4, 0)}


def occurrences(sents: DataFrame, unit: str = "n2", words: str = "words") -> DataFrame:
    """(topic_id, doc_id, ord, concept), one row per distinct concept of a sentence."""
    return sents.select("topic_id", "doc_id", "ord", F.explode(F.array_distinct(T.units(F.col(words), unit))).alias("concept"))


def with_overlap(sents: DataFrame, queries: DataFrame, stop: tuple[str, ...], words: str = "words", stem: bool = False) -> DataFrame:
    """sents with overlap: how many distinct query words, stopwords aside, each has. queries(topic_id, query): one row a topic.

    stem: words are stems already; query words lose their stopwords and are stemmed then, while stems of sentences are held against the list as it is.
    """
    asked = T.without_stopwords(T.tokenize(F.col("query")), stop)
    q = queries.select("topic_id", F.array_distinct(stem_arrays(asked) if stem else asked).alias("q"))
    own = T.without_stopwords(F.array_distinct(F.col(words)), stop)
    return sents.join(F.broadcast(q), "topic_id", "left").withColumn("overlap", F.coalesce(F.size(F.array_intersect(own, F.col("q"))), F.lit(0))).drop("q")


def markers(sents: DataFrame, rule: Rule, unit: str = "n2") -> DataFrame:
    """(topic_id, concept, n_markers, n_first): distinct (document, is first sentence) markers of a concept over sentences with enough overlap."""
    seen = occurrences(sents.filter(F.col("overlap") >= rule.overlap), unit).select("topic_id", "concept", "doc_id", (F.col("ord") == 0).alias("first")).distinct()
    return seen.groupBy("topic_id", "concept").agg(F.count("*").alias("n_markers"), F.sum(F.col("first").cast("long")).alias("n_first"))


def not_just_stopwords(concept: Column, stop: tuple[str, ...]) -> Column:
    return ~T.just_stopwords(F.split(concept, "_"), stop)


def production_weights(sents: DataFrame, rule: Rule, stop: tuple[str, ...], unit: str = "n2") -> DataFrame:
    """(topic_id, concept, weight): markers plus the rule's share for first sentences, thresholded."""
    w = markers(sents, rule, unit).withColumn("weight", F.col("n_markers") + rule.first * F.col("n_first"))
    return w.filter((F.col("weight") >= rule.least) & not_just_stopwords(F.col("concept"), stop)).select("topic_id", "concept", "weight")


def baseline_weights(sents: DataFrame, unit: str = "n2") -> DataFrame:
    """Document frequency over sentences with any overlap; a first sentence counts its document once more."""
    w = markers(sents, Rule(0, 0, 1), unit)
    first = occurrences(sents.filter("overlap >= 1 and ord = 0"), unit).groupBy("topic_id", "concept").agg(F.countDistinct("doc_id").alias("f"))
    docs = occurrences(sents.filter("overlap >= 1"), unit).groupBy("topic_id", "concept").agg(F.countDistinct("doc_id").alias("d"))
    return w.select("topic_id", "concept").join(docs, ["topic_id", "concept"]).join(first, ["topic_id", "concept"], "left").select("topic_id", "concept", (F.col("d") + F.coalesce("f", F.lit(0))).alias("weight"))


def gold_weights(gold: DataFrame, unit: str = "n2") -> DataFrame:
    """gold(topic_id, annotator, text): the number of annotators who use a concept."""
    units = gold.select("topic_id", "annotator", F.explode(F.array_distinct(T.units(T.tokenize(F.col("text")), unit))).alias("concept"))
    return units.groupBy("topic_id", "concept").agg(F.countDistinct("annotator").alias("weight"))


def df_or_tf(sents: DataFrame, unit: str = "n2", least: int = 3, many: int = 3) -> DataFrame:
    """Document frequency in topics of more than `many` documents, else the number of sentences; kept from `least`."""
    n = sents.groupBy("topic_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    w = occurrences(sents, unit).groupBy("topic_id", "concept").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("tf"))
    return w.join(F.broadcast(n), "topic_id").select("topic_id", "concept", F.when(F.col("n_docs") > many, F.col("df")).otherwise(F.col("tf")).alias("weight")).filter(F.col("weight") >= least)


def location_weights(sents: DataFrame, unit: str = "n2") -> DataFrame:
    """The best 1 / (position + 1) at which a concept stands in sentences of 5 words or more."""
    return occurrences(sents.filter("length >= 5"), unit).groupBy("topic_id", "concept").agg(F.max(1.0 / (F.col("ord") + 1)).alias("weight"))


def candidates(sents: DataFrame, least: int = 10) -> DataFrame:
    """Sentences of `least` words or more that aren't quoted, the first of each wording in a topic.

    The first of a wording is a minimum, combined before the shuffle; wordings that
    repeat thousands of times cost one row a task.
    """
    place = F.struct("doc_id", "ord")
    able = sents.filter((F.col("length") >= least) & ~T.is_quoted(F.col("orig"))).withColumn("wording", F.xxhash64(F.concat_ws(" ", "words")))
    first = able.groupBy("topic_id", "wording").agg(F.min(place).alias("p"))
    return able.join(first, ["topic_id", "wording"]).filter(place == F.col("p")).drop("wording", "p")


def incidence(cands: DataFrame, weights: DataFrame, unit: str = "n2") -> DataFrame:
    """(topic_id, doc_id, ord, concept) of candidates and kept concepts."""
    return occurrences(cands, unit).join(weights.select("topic_id", "concept"), ["topic_id", "concept"], "left_semi").select("topic_id", "doc_id", "ord", "concept")


def found_in_text(concepts: Column, words: Column) -> Column:
    """The concepts, in the order given, that stand in the words; a found one takes its words from all that come later."""
    start = F.struct(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(now, concept):
        own = F.concat(F.lit(" "), F.replace(concept, F.lit("_"), F.lit(" ")), F.lit(" "))
        taken = F.struct(F.replace(now["left"], own, F.lit(" <MATCHED> ")).alias("left"), F.array_append(now["found"], concept).alias("found"))
        return F.when(F.contains(now["left"], own), taken).otherwise(now)

    return F.aggregate(concepts, start, step)["found"]


def sentence_values(sents: DataFrame) -> DataFrame:
    """(topic_id, doc_id, ord, value): overlap normalised within the topic; topics without any are left out."""
    total = sents.groupBy("topic_id").agg(F.sum("overlap").alias("t")).filter("t > 0")
    return sents.join(F.broadcast(total), "topic_id").filter("overlap > 0").select("topic_id", "doc_id", "ord", (F.col("overlap") / F.col("t")).alias("value"))


def propagate_to_concepts(values: DataFrame, occ: DataFrame) -> DataFrame:
    """Half a round of mutual reinforcement: a concept's value is the normalised sum of its sentences' values."""
    raw = stored(occ.join(values, ["topic_id", "doc_id", "ord"]).groupBy("topic_id", "concept").agg(F.sum("value").alias("v")), "concept-values")
    return _normalised(raw, "concept")


def propagate_to_sentences(values: DataFrame, occ: DataFrame) -> DataFrame:
    """The other half: a sentence's value is the normalised sum of its concepts' values."""
    raw = stored(occ.join(values, ["topic_id", "concept"]).groupBy("topic_id", "doc_id", "ord").agg(F.sum("value").alias("v")), "sentence-values")
    return _normalised(raw, "doc_id", "ord")


def _normalised(raw: DataFrame, *keys: str) -> DataFrame:
    total = raw.groupBy("topic_id").agg(F.sum("v").alias("t"))
    return raw.join(F.broadcast(total), "topic_id").select("topic_id", *keys, (F.col("v") / F.col("t")).alias("value"))


def query_expand(sents: DataFrame, unit: str = "n2", rounds: int = 2) -> DataFrame:
    """(topic_id, concept, value) after `rounds` rounds from the query overlap; each half round is stored, so that the next one and the totals read it."""
    sents = stored(sents.select("topic_id", "doc_id", "ord", "words", "overlap"), "overlaps")
    occ, v = stored(occurrences(sents, unit), "occurrences"), sentence_values(sents)
    for k in range(rounds):
        c = propagate_to_concepts(v, occ)
        v = propagate_to_sentences(c, occ) if k + 1 < rounds else v
    return c


def top_concepts(values: DataFrame, k: int = 65) -> DataFrame:
    """The k largest values of a topic, ties by name."""
    w = W.partitionBy("topic_id").orderBy(F.desc("value"), "concept")
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cooccurrence(sents: DataFrame, stop: tuple[str, ...], least: int = 8) -> DataFrame:
    """(topic_id, a, b, n): sentences that hold both words, a < b, stopwords and words under `least` letters aside.

    A sentence's pairs are made within its row and combined before the shuffle.
    """
    w = F.array_sort(F.array_distinct(F.filter(T.without_stopwords(F.col("words"), stop), lambda x: F.length(x) >= least)))
    rows = sents.select("topic_id", w.alias("w"))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select("topic_id", F.explode(pairs).alias("p")).groupBy("topic_id", "p.a", "p.b").agg(F.count("*").alias("n"))


def heuristic_weights(sents: DataFrame, stop: tuple[str, ...], unit: str = "n2", least: int = 3, words: int = 5) -> DataFrame:
    """df_or_tf over the first of each wording in a topic, of `words` words or more and with a query word; concepts of stopwords alone go."""
    place = F.struct("doc_id", "ord")
    able = sents.filter((F.col("length") >= words) & (F.col("overlap") > 0)).withColumn("wording", F.xxhash64(F.concat_ws(" ", "words")))
    first = able.groupBy("topic_id", "wording").agg(F.min(place).alias("p"))
    kept = able.join(first, ["topic_id", "wording"]).filter(place == F.col("p"))
    return df_or_tf(kept, unit, least).filter(not_just_stopwords(F.col("concept"), stop))


def lead_candidates(sents: DataFrame, words: int = 5) -> DataFrame:
    """(topic_id, doc_id, ord): of each document the first sentence of over `words` words whose wording no earlier sentence of the topic has."""
    place = F.struct("doc_id", "ord")
    able = sents.filter(F.col("length") > words).withColumn("wording", F.xxhash64(F.concat_ws(" ", "words")))
    first = able.groupBy("topic_id", "wording").agg(F.min(place).alias("p"))
    return first.groupBy("topic_id", F.col("p.doc_id").alias("doc_id")).agg(F.min("p.ord").alias("ord"))


def paragraph_starters(docs: DataFrame, words: int = 20) -> DataFrame:
    """(topic_id, doc_id, par, orig): the first sentences of paragraphs, of `words` words or more, the first of each wording in a topic. docs(topic_id, doc_id, text)."""
    pars = docs.select("topic_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("par", "p"))
    starts = pars.select("topic_id", "doc_id", "par", F.get(T.split_sentences(F.col("p")), F.lit(0)).alias("orig")).filter(T.n_words(F.col("orig")) >= words)
    return starts.groupBy("topic_id", "orig").agg(F.min(F.struct("doc_id", "par")).alias("p")).select("topic_id", "p.doc_id", "p.par", "orig")


def variants(sents: DataFrame) -> DataFrame:
    """sents with a row per distinct wording of a sentence: as it is, cleaned, cleaned aggressively; variant counts them, words and length are the wording's."""
    texts = T.let(T.clean_sentence(F.col("orig")), lambda x: F.array_distinct(F.array(F.col("orig"), x, T.tightened(x))))
    rows = sents.select("topic_id", "doc_id", "ord", F.posexplode(texts).alias("variant", "orig"))
    return rows.withColumn("words", T.tokenize(F.col("orig"))).withColumn("length", T.n_words(F.col("orig")))


def variant_incidence(sents: DataFrame, weights: DataFrame, least: int = 10, unit: str = "n2") -> DataFrame:
    """(topic_id, doc_id, ord, variant, concept): kept concepts of the wordings of `least` words or more that aren't quoted. Weights come from the originals."""
    v = variants(sents).filter((F.col("length") >= least) & ~T.is_quoted(F.col("orig")))
    occ = v.select("topic_id", "doc_id", "ord", "variant", F.explode(F.array_distinct(T.units(F.col("words"), unit))).alias("concept"))
    return occ.join(weights.select("topic_id", "concept"), ["topic_id", "concept"], "left_semi")


def with_entities(weights: DataFrame, entities: DataFrame, fudge: float, least: int = 1) -> DataFrame:
    """weights and the concepts of an extractor, marked __ie__: and weighing fudge times their documents. entities(topic_id, doc_id, entity)."""
    e = entities.groupBy("topic_id", F.concat(F.lit("__ie__:"), "entity").alias("concept")).agg((fudge * F.countDistinct("doc_id")).alias("weight")).filter(F.col("weight") >= least)
    return weights.withColumn("weight", F.col("weight").cast("double")).unionByName(e)


def flagged(lines: DataFrame, column: str, flag: str, keep: bool) -> DataFrame:
    """lines that end with |flag, or those that don't."""
    ends = F.endswith(column, F.lit(f"|{flag}"))
    return lines.filter(ends if keep else ~ends)


def document_reinforcement(occ: DataFrame) -> DataFrame:
    """(topic_id, concept, value): a round of reinforcement from documents of equal value: a concept's share of its topic's document frequencies."""
    df = stored(occ.groupBy("topic_id", "concept").agg(F.countDistinct("doc_id").alias("v")), "document-frequencies")
    return _normalised(df, "concept")

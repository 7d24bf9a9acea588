"""Concept document frequencies over a stream of documents, and windowed event counts.

An extension: the batch rules have no notion of late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevis.functions import text as T


def concept_stream(docs: DataFrame, late: str = "1 day", unit: str = "n2") -> DataFrame:
    """(topic_id, concept, df): documents seen with a concept, for a stream (topic_id, doc_id, ts, text).

    A document that arrives twice within the watermark counts once; state is dropped
    with the watermark. Use with output mode update or complete.
    """
    once = docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["topic_id", "doc_id"])
    sents = once.select("topic_id", F.explode(F.array_distinct(F.flatten(F.transform(T.split_sentences(F.col("text")), lambda s: T.units(T.tokenize(s), unit))))).alias("concept"))
    return sents.groupBy("topic_id", "concept").agg(F.count("*").alias("df"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream (ts, event_type, value), appended when the watermark passes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")

"""Substring dedup by hashing paragraphs, or lines, and winnowed runs of words.

A unit is a paragraph (a run of lines that aren't blank) or, on request, a line, of
any length that has a word. Beside these, winnowed runs of GRAM words are units,
whatever lines and sentences they cross: of WINDOW runs that start at neighbouring
words, one of the least hash is taken, so that any passage of GRAM + WINDOW - 1 = 35
words that two places share has a whole unit in common. Units are normalised (lower
case, words only) and grouped by a 128-bit digest over the whole table. The
earliest occurrence stays, by document id and then by place; every later one is
reported as a span of code points of the text as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, met, written

#: Words of a winnowed unit (a power of two), and the starts among which one is taken.
GRAM, WINDOW = 16, 20
UNITS = ("paragraph", "line")
_WORD = re.compile(r"\w+")


def units(text: str, unit: str = "paragraph") -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the paragraphs or lines that have a word, in order, without the white space around them, then of the winnowed runs that aren't one of them."""
    out = _whole(text, unit)
    own = {(a, z) for a, z, _ in out}
    return out + [u for u in _winnowed(text) if u[:2] not in own]


def _blocks(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the lines, or of the runs of lines that aren't blank."""
    at, start, last = 0, None, 0
    for line in text.split("\n"):
        end = at + len(line)
        if unit == "line":
            yield at, end
        elif line.strip():
            start, last = at if start is None else start, end
        elif start is not None:
            yield start, last
            start = None
        at = end + 1
    if start is not None:
        yield start, last


def _whole(text: str, unit: str) -> list[tuple[int, int, bytes]]:
    out = []
    for a, z in _blocks(text, unit):
        piece = text[a:z]
        if words := _WORD.findall(piece.lower()):
            out.append((z - len(piece.lstrip()), a + len(piece.rstrip()), _digest(words)))
    return out


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))


def _winnowed(text: str) -> list[tuple[int, int, bytes]]:
    found = list(_WORD.finditer(text))
    if len(found) < GRAM + WINDOW - 1:
        return []
    words = [m.group().lower() for m in found]
    g = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    width = 1
    while width < GRAM:  # from here on g[i] stands for twice as many words from the i-th on
        g = (g[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (g[:-width] >> np.uint64(29)) ^ (g[width:] * np.uint64(0xC2B2AE3D27D4EB4F))
        width *= 2
    last = WINDOW - 1 - np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1].argmin(1)
    at = np.unique(last + np.arange(len(last)))
    return [(found[i].start(), found[i + GRAM - 1].end(), _digest(words[i : i + GRAM])) for i in _thinned(at.tolist(), g[at].tolist())]


def _thinned(at: list[int], value: list[int]) -> list[int]:
    """at without places between two of equal value that are at most WINDOW apart: every window keeps one of its least."""
    out, kept = [], None
    for i, p in enumerate(at):
        if i + 1 < len(at) and kept == value[i] == value[i + 1] and at[i + 1] - out[-1] <= WINDOW:
            continue
        out.append(p)
        kept = value[i]
    return out


def _unit_batches(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, digest = [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                for a, z, d in units(text, unit) if text else ():
                    row.append(r)
                    start.append(a)
                    end.append(z)
                    digest.append(d)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("row").take(row), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "row", "start", "end", "digest"])

    return run


def _later(rows: DataFrame, unit: str) -> DataFrame:
    """rows(doc_id, row, text) -> every unit to remove: doc_id, row, start, end, first_doc_id, first_start, digest."""
    found = written(arrow_map(rows.select("doc_id", "row", "text"), _unit_batches(unit), f"doc_id {dict(rows.dtypes)['doc_id']}, row long, start int, end int, digest binary"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "start", "row")
    first = found.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "end")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    overlaps = (F.col("row") == F.col("first.place.row")) & (F.col("start") < F.col("first.end"))
    later = met(found, written(first, "first"), "digest", total=found.count()).filter((place != F.col("first.place")) & ~overlaps)
    return later.select("doc_id", "row", "start", "end", F.col("first.place.doc_id").alias("first_doc_id"), F.col("first.place.start").alias("first_start"), F.lower(F.hex("digest")).alias("digest"))


def repeated_units(docs: DataFrame, unit: str = "paragraph") -> DataFrame:
    """The units to remove from docs(doc_id, text): doc_id, start, end (code points, end exclusive), first_doc_id, first_start, digest.

    Occurrences rank by doc_id (null last), then by start, then by the row's place in
    the table, so that of a repeated row one stays; one that overlaps the first in the
    same row isn't a repeat. Null, empty and unit-less texts
    give no rows; a very long text is one row of work, linear in its length; other
    columns are ignored, whatever their names; an empty table gives an empty one. The
    grouping combines before the shuffle. In the join back, the occurrences of a unit
    that has over a thousandth of all of them stay where they are.
    """
    return _later(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), unit).drop("row")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans; what stands around them stays as it is."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def _remove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t is None else without(t, [(x["start"], x["end"]) for x in s or ()]) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def remove_repeated(docs: DataFrame, unit: str = "paragraph") -> DataFrame:
    """(doc_id, text) of every row of docs, with the repeated units taken out.

    A row loses the spans that were reported for it, and no other row's, even where
    ids repeat or are null: of rows with one id and one text, the first keeps it and
    the others end up without its units. Null texts stay null, texts without a
    repeated unit stay as they are to the byte, an empty table gives an empty one, and
    other columns are ignored.
    """
    rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "rows")
    per = _later(rows, unit).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return arrow_map(rows.join(per, "row", "left").select("doc_id", "text", "spans"), _remove_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")

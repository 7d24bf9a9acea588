"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed letter n-grams, of length one. A language's
labelled sample is clustered by spherical k-means; a text gets the language of the
centroid with the largest cosine. It is rejected if that cosine is under half of
the smallest one among the sample's texts of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod
from .features import DIMS, letter_counts

#: Labelled rows used per language, as expected from a threshold on a hash; n-gram document frequencies cover all of them.
SAMPLE = 800
CENTROIDS = 4
FOLDS = 5
UNKNOWN = "und"
#: Length classes for the rejection limit: log2 of the letters.
CLASSES = 28


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray  # DIMS x (languages x CENTROIDS)
    owner: np.ndarray  # language of each centroid
    limits: np.ndarray  # language x length class: distance beyond which a text is rejected

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        counts = letter_counts(text)
        at = np.flatnonzero(counts)
        x = ((1 + np.log(counts[at])) * self.idf[at]).astype(np.float32)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum())
        return at, x / np.float32(norm) if norm else x, _length_class(int(counts.sum()))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, distance, rejected)."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 1.0, True
        if not self.langs:
            return UNKNOWN, 0.0, 1.0, False
        at, x, size = self.vector(text)
        cosines = x @ self.centroids[at]
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        k = int(self.owner[best])
        return self.langs[k], score, 1.0 - score, bool(1.0 - score > self.limits[k, size])


def _length_class(n: int) -> int:
    return min(CLASSES - 1, n.bit_length())


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, np.int64)
    for b in batches:
        for text in b.column("text").to_pylist():
            total += letter_counts(text) > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def _vector_batches(idf: np.ndarray):
    model = Model(idf, [], np.zeros((DIMS, 0)), np.zeros(0), np.zeros((0, CLASSES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.vector(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.int32())], names=["lang", "rank", "at", "x", "size"])

    return run


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means over rows of length one; starts from the first row and then the row farthest from the chosen ones."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(12):
        own = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = x[own == j].sum(0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def _fit_language(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rank", kind="stable")
    x = np.zeros((len(pdf), DIMS), np.float32)
    for i, (at, v) in enumerate(zip(pdf["at"], pdf["x"], strict=True)):
        x[i, at] = v
    centres = cluster(x, CENTROIDS)
    far, size = 1.0 - (x @ centres.T).max(1), pdf["size"].to_numpy()
    worst = {c: far[size == c].max() for c in set(size.tolist())}
    limits = np.ones(CLASSES)
    for c in range(CLASSES):
        # half of the worst cosine of the class; a class longer than the sample's has the limit of the longest, and one
        # shorter has half the cosine for each class that it is shorter, since short texts share little with anything
        near = min(worst, key=lambda w: (abs(w - c), w))
        limits[c] = 1 - (1 - worst[near]) / 2 ** (1 + max(0, near - c))
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "centres": [centres.ravel()], "limits": [limits]})


def fit(docs: DataFrame, key: Column) -> Model:
    """Learns from docs(text, lang) rows with a language, a letter and a row key; key orders and samples them."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64(key, "text"), F.lit(1 << 40)).alias("rank")).filter("lang is not null and text is not null").filter(F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.ones(DIMS, np.float32), [], np.zeros((DIMS, 0), np.float32), np.zeros(0, int), np.ones((0, CLASSES)))
    found = arrow_map(labelled.select("text"), _frequency_batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(DIMS)
    df[found["bucket"]] = found["n"]
    idf = (np.log((1 + sum(counts.values())) / (1 + df)) + 1).astype(np.float32)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 40, -(-SAMPLE * (1 << 40) // n)))])
    sample = labelled.filter(F.col("rank") < share[F.col("lang")]).dropDuplicates(["lang", "rank"])  # copies of a row count once, so that the sample keeps its bound
    rows = arrow_map(sample, _vector_batches(idf), "lang string, rank long, at array<int>, x array<float>, size int").groupBy("lang").applyInPandas(_fit_language, "lang string, centres array<float>, limits array<double>").toArrow().to_pandas().sort_values("lang")
    centres = [np.asarray(c, np.float32).reshape(-1, DIMS) for c in rows["centres"]]
    return Model(idf, list(rows["lang"]), np.ascontiguousarray(np.concatenate(centres).T), np.repeat(np.arange(len(centres)), [len(c) for c in centres]), np.stack(list(rows["limits"])))


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(t) for t in b.column("text").to_pylist()]
            lang, score, far, no = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64()), pa.array(no, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "distance", "rejected"])

    return run


def _keep_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield b.filter(pa.array([not model.predict(t)[3] for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_mod(F.col("doc_id"), FOLDS) != 0)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score, distance, rejected.

    Learns from rows whose crc32(doc_id) mod 5 isn't 0. A null text, or one without
    a letter, is "und" with score 0 and rejected; so is, unrejected, every text if
    nothing is labelled. A null id is not held out and not learned from. Equal cosines
    go to the first language by name. Repeated rows come out as often as they came
    in; other columns are ignored; an empty table gives an empty one.
    """
    model = fit(_training(docs), F.col("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS x 64 KB a language
    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, _predict_batches(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, distance double, rejected boolean")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without the rows that have no known language.

    Null, empty and letterless texts go; so do texts too far from every centroid. A
    very long text is judged whole. With nothing labelled every text with a letter
    stays. Ties go to the first language by name, repeated rows stay as often as they
    came in, no column is added or lost, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(_training(docs), F.col("doc_id")))
    return arrow_map(docs, _keep_batches(shared), docs.schema)

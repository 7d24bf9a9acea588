"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives each document's posterior over
domains. Document rates, none negative, are then fitted so that the expected
tokens of each domain, sum over documents of rate x tokens x posterior, match
targets: least squares by projected gradient. A gradient step moves every rate by
the same K numbers times the document's posteriors and clips it at zero, so the
rates follow from the posteriors and the list of steps taken; an iteration is one
aggregation of K sums over a narrow table, and no rate is ever stored or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written
from .features import DIMS, byte_counts

#: Labelled rows that the classifier may use, as expected from a threshold on a hash.
SAMPLE = 20_000
#: Production targets: a domain's share of tokens to this power, so that small domains gain.
TEMPERATURE = 0.7
EVIDENCE = 200
PATIENCE, TOLERANCE = 10, 1e-9


@dataclass
class Classifier:
    """Multinomial naive Bayes on hashed byte n-grams; a text's evidence counts as that of EVIDENCE n-grams at most, so that posteriors stay soft."""

    domains: list[str]
    prior: np.ndarray
    weights: np.ndarray  # DIMS x domains

    def posterior(self, data: bytes | None) -> np.ndarray:
        counts = byte_counts(data or b"")
        at = np.flatnonzero(counts)
        total = counts.sum()
        x = self.prior + (counts[at] @ self.weights[at] * (min(total, EVIDENCE) / total) if total else 0.0)
        x = np.exp(x - x.max())
        return x / x.sum()


def _count_batches(domains: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((len(domains), DIMS), np.int64), np.zeros(len(domains), np.int64)
        place = {d: i for i, d in enumerate(domains)}
        for b in batches:
            for domain, data in zip(b.column("domain").to_pylist(), b.column("text").to_pylist(), strict=True):
                total[place[domain]] += byte_counts(data)
                docs[place[domain]] += 1
        d, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d, np.arange(len(domains))]).astype(np.int32)), pa.array(np.concatenate([at, np.full(len(domains), -1)]).astype(np.int32)), pa.array(np.concatenate([total[d, at], docs]))], names=["domain", "bucket", "n"])

    return run


def learn(docs: DataFrame, labelled: DataFrame) -> Classifier:
    """labelled(doc_id, domain): rows with a null are ignored; of several domains of an id the first by name counts."""
    own = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    names = own.groupBy("domain").agg(F.count("*").alias("n")).collect()
    domains, n = sorted(r["domain"] for r in names), sum(r["n"] for r in names)
    if not domains:
        return Classifier([], np.zeros(0), np.zeros((DIMS, 0)))
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, -(-SAMPLE * (1 << 30) // n)))
    texts = docs.filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(own), "doc_id").select("domain", "text")  # SAMPLE rows of an id and a name
    found = arrow_map(texts, _count_batches(domains), "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    counts, rows = np.zeros((DIMS, len(domains))), np.zeros(len(domains))
    grams = found[found["bucket"] >= 0]
    counts[grams["bucket"], grams["domain"]] = grams["n"]
    single = found[found["bucket"] < 0]
    rows[single["domain"]] = single["n"]
    p = (counts + 0.5) / (counts.sum(0) + 0.5 * DIMS)
    return Classifier(domains, np.log((rows + 1) / (rows.sum() + len(domains))), np.log(p))


def _posterior_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()), pa.array([model.posterior(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    return run


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posterior array<double>) of every row; tokens are separated by ASCII white space."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x domains
    return arrow_map(docs.select("doc_id", F.col("text").cast("binary").alias("text")), _posterior_batches(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, posterior array<double>")


def rate(steps: list[list[float]]) -> Column:
    """The rate that the steps give a document, from its posterior."""
    one = F.lit(1.0)
    if not steps:
        return one
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(moves, one, lambda r, s: F.greatest(F.lit(0.0), r + F.aggregate(F.zip_with(F.col("posterior"), s, lambda q, x: q * x), F.lit(0.0), lambda a, x: a + x)))


def tempered(totals: np.ndarray) -> np.ndarray:
    """Production targets from the natural totals of the domains; they add up to the same."""
    w = np.power(totals, TEMPERATURE)
    return totals.sum() * w / w.sum() if w.sum() else totals


def fit_rates(soft: DataFrame, k: int, targets=tempered) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(steps, targets, reached totals) for soft(n_tokens, posterior); targets: the natural totals to the wanted ones.

    Steps are scaled by the inverse of the Gram matrix of the posteriors of rows that
    aren't clipped, which is the exact step until another row is. They go on until the
    targets are met, or, where no rates meet them, until PATIENCE steps brought nothing;
    the best steps are returned, and what they miss can be read from the totals.
    """
    q = [F.element_at("posterior", i + 1) for i in range(k)]
    if not k:
        return [], np.zeros(0), np.zeros(0)

    def sums(steps):
        """Totals at these rates, and the Gram matrix of the rows whose rate isn't clipped: K + K x K sums in one aggregation."""
        rows = soft.withColumn("r", rate(steps))
        free = F.when(F.col("r") > 0, F.col("n_tokens")).otherwise(0)
        cols = [F.sum(F.col("r") * F.col("n_tokens") * x) for x in q] + [F.sum(free * x * y) for x in q for y in q]
        got = np.array(rows.agg(*[F.coalesce(c, F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(cols)]).first(), float)
        return got[:k], got[k:].reshape(k, k)

    steps: list[list[float]] = []
    totals, gram = sums(steps)
    wanted = np.asarray(targets(totals), float)
    best = (np.abs(wanted - totals).max(), 0, totals)
    while best[0] > TOLERANCE * max(wanted.max(), 1e-300) and len(steps) - best[1] < PATIENCE:
        steps.append((np.linalg.pinv(gram) @ (wanted - totals)).tolist())
        totals, gram = sums(steps)
        best = min(best, (np.abs(wanted - totals).max(), len(steps), totals), key=lambda x: x[0])
    return steps[: best[1]], wanted, best[2]


def residual(wanted: np.ndarray, reached: np.ndarray) -> float:
    """The largest miss of a domain's total, as a share of the largest target."""
    return float(np.abs(wanted - reached).max() / max(wanted.max(), 1e-300)) if wanted.size else 0.0


def document_rates(docs: DataFrame, labelled: DataFrame, targets=tempered) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_tokens, posterior map<domain, double>, rate double, residual double (of the whole fit).

    A null or blank text has no tokens, the prior as its posterior, and a rate like
    any other's; with nothing labelled there is no domain and every rate is 1. Null
    and repeated ids come out as they came in; other columns are ignored; an empty
    table gives an empty one.
    """
    model = learn(docs, labelled)
    if not model.domains:
        tokens = F.when(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0, F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+"))).otherwise(0)
        return docs.select("doc_id", tokens.cast("long").alias("n_tokens"), F.create_map().cast("map<string,double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(0.0).alias("residual"))
    soft = written(posteriors(docs, model), "posteriors")
    steps, wanted, reached = fit_rates(soft, len(model.domains), targets)
    return soft.withColumn("rate", rate(steps)).select("doc_id", "n_tokens", F.map_from_arrays(F.array(*map(F.lit, model.domains)), F.col("posterior")).alias("posterior"), "rate", F.lit(residual(wanted, reached)).alias("residual"))


def _mix_batches(shared, steps: list[list[float]]):
    moves = [np.array(s) for s in steps]

    def copies(key, data: bytes | None, model: Classifier) -> int:
        q, r = model.posterior(data), 1.0
        for s in moves:
            r = max(0.0, r + float(q @ s))
        draw = xxhash.xxh64_intdigest(f"{key}|{xxhash.xxh64_hexdigest(data or b'')}".encode()) / 2.0**64
        return int(r + draw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            times = [copies(k, (t or "").encode(), model) for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield b.take(pa.array(np.repeat(np.arange(b.num_rows), times)))

    return run


def mix(docs: DataFrame, labelled: DataFrame, targets=tempered) -> DataFrame:
    """docs, each row as often as its rate says: the whole part, and once more if a draw seeded by id and text falls below the rest.

    Null and empty texts have the prior's rate, a null id is a key like any other, and
    rows that share an id and a text share the draw. No column is added or lost; an
    empty table gives an empty one; with nothing labelled docs come back as they are.
    """
    model = learn(docs, labelled)
    if not model.domains:
        return docs
    steps, _, _ = fit_rates(written(posteriors(docs, model), "posteriors"), len(model.domains), targets)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, _mix_batches(shared, steps), docs.schema)

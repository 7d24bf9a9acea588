"""Embedding near-duplicates over small-world graphs, one graph per shard of the vectors.

Equal vectors are one class. Classes are dealt to shards by a hash; each shard's
graph is built once and written. Every class queries every shard, in blocks of
queries. A task audits its recall against brute force on some of its queries that have
links, query by query, and widens its beam until the audit passes, the last widening being the whole shard.
Links are verified by cosine in double precision where single precision could err.
A task folds the pairs of a chunk of queries at once into the number of links per
query and per node and into a spanning forest of what it linked, so that a group of
near copies costs its members, not its pairs. A vector's links are those it found or
those that found it, whichever are more: the two differ only where a beam missed one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import NARROW_ROWS, arrow_map, met, written
from .graph import components
from .hnsw import LOWER, Graph, together
from .simhash import link

LEAST = 0.9
#: Shards: as many for small tables, and so many that a graph has at most this many vectors on average.
SHARDS, SHARD_SIZE, BLOCK_SIZE = 8, 200_000, 50_000
#: Bytes of a shard's vectors in double precision, which keeps a packed graph under 1 GB; queries and similarities that are folded at once.
SHARD_BYTES, CHUNK, CELLS = 600 << 20, 2048, 8_000_000
BEAM, SLACK = 16, 0.04
#: Queries of an audit, which all have links; draws to find them; the mean recall of a query asked for in every degree class.
AUDIT, DRAWS, RECALL = 256, 4096, 0.995
#: Similarities this near to LEAST are computed again in double precision.
NEAR = 1e-4


def _packed(kind: str):
    """Rows (row, vec_id, embedding) with the vector as the bytes of its components, null where it links with nothing: bytes are grouped, joined and read at a fraction of an array's cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, values = lists.offsets.to_numpy(), lists.values
            x = values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # null is NaN, and -0.0 becomes 0.0
            bad, some = (np.concatenate([[0], np.cumsum(c)]) for c in (~np.isfinite(x), x != 0))
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            raw, at = x.tobytes(), (at * x.itemsize).tolist()
            packed = [raw[lo:hi] if k else None for lo, hi, k in zip(at, at[1:], ok.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["row", "vec_id", "embedding"])

    return run


def _unit(rows: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one in double and in single precision."""
    raw = b"".join(rows)
    x = np.frombuffer(raw, f"<f{len(raw) // (len(rows) * dim)}").astype(np.float64).reshape(len(rows), dim)
    x /= np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x, x.astype(np.float32)


def _pack(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cls")
    exact, x = _unit(pdf["embedding"], pdf["dim"].iloc[0])
    g = Graph(x)
    packed = {f"links{i}": a.astype(np.int32) for i, a in enumerate(g.links)}
    blob = _pack(exact=exact[g.order], cls=pdf["cls"].to_numpy()[g.order], m=pdf["m"].to_numpy()[g.order], sizes=np.array(g.sizes), **packed)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [blob]})


def _load(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    a = np.load(io.BytesIO(blob))
    g = Graph.__new__(Graph)
    g.x, g.sizes = a["exact"].astype(np.float32), a["sizes"].tolist()
    g.links = [a[f"links{i}"].astype(np.int64) for i in range(len(g.sizes))]
    return g, a["exact"], a["cls"], a["m"]


def _brute(x: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of at least `least`, for as many queries as a caller can hold the pairs of."""
    s = q @ x.T
    a, b = np.nonzero(s >= least)
    return a, b, s[a, b]


def _per_query(who: np.ndarray, node: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hits per query without the query itself, own being its node or -1."""
    return np.bincount(who[node != own[who]], minlength=len(own))


def _degrees(x: np.ndarray, q: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """True links per query."""
    size, out = max(1, CELLS // len(x)), [np.empty(0, np.int64)]
    for lo in range(0, len(q), size):
        near, mine = q[lo : lo + size] @ x.T >= least, own[lo : lo + size]
        out.append(np.count_nonzero(near, axis=1) - ((mine >= 0) & near[np.arange(len(mine)), mine]))
    return np.concatenate(out)


def _audit(g: Graph, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, their own nodes, their true links) for an audit: drawn ones that have links besides themselves, and where those are few, nodes moved until they are just `least` and a little more from where they were."""
    rng = np.random.default_rng(len(q))
    drawn, queries, owns, links = rng.permutation(len(q))[:DRAWS], [], [], []
    for lo in range(0, len(drawn), AUDIT):
        at = drawn[lo : lo + AUDIT]
        n = _degrees(g.x, q[at], own[at], least)
        queries.append(q[at[n > 0]])
        owns.append(own[at[n > 0]])
        links.append(n[n > 0])
        if sum(map(len, links)) >= AUDIT:
            break
    short = AUDIT - sum(map(len, links))
    if short > 0:
        x = g.x[rng.integers(0, len(g.x), short)].astype(np.float64)
        aside = rng.normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        length = np.sqrt((aside * aside).sum(1, keepdims=True))
        near = min(1.0, least + 0.2 * (1 - least))
        moved = np.where(length > 1e-9, near * x + np.sqrt(1 - near * near) * aside / np.maximum(length, 1e-9), x).astype(np.float32)
        queries.append(moved)
        owns.append(np.full(short, -1))
        links.append(_degrees(g.x, moved, owns[-1], least))
    return np.concatenate(queries), np.concatenate(owns), np.concatenate(links)


def _passes(found: np.ndarray, truth: np.ndarray) -> bool:
    """Whether the mean recall of a query is enough in each class of degrees (1 to 3, 4 to 15, and so on): a dense group can't hide the links of small ones."""
    degree = np.floor(np.log2(np.maximum(truth, 1)) / 2).astype(int)
    share = found / np.maximum(truth, 1)
    return all(share[degree == k].mean() >= RECALL for k in np.unique(degree))


def widen(g: Graph, q: np.ndarray, least: float, beam: int = BEAM, slack: float = SLACK, own: np.ndarray | None = None) -> tuple[int, float] | None:
    """The beam and slack with which audited queries find RECALL of their links, whether these are few or many; None for the whole shard.

    A beam that would look at a quarter of the shard is widened to all of it at once:
    that is exact, and costs no more, a query times the shard instead of a query
    times its neighbourhoods.
    """
    own = np.full(len(q), -1) if own is None else own
    if 4 * LOWER * beam > len(g.x):
        return None
    audited, owns, truth = _audit(g, q, own, least)
    while True:
        found, size = [], together(len(g.x))
        for lo in range(0, len(audited), size):
            who, node, _ = g.within(audited[lo : lo + size], least, beam, slack)
            found.append(_per_query(who, node, owns[lo : lo + size]))
        if _passes(np.concatenate(found), truth):
            return beam, slack
        beam, slack = 4 * beam, 2 * slack
        if 4 * LOWER * beam > len(g.x):
            return None


def search(g: Graph, q: np.ndarray, least: float, beam: int = BEAM, slack: float = SLACK, own: np.ndarray | None = None):
    """Yields (first query, pairs of at least `least`) by chunks of queries."""
    wide = widen(g, q, least, beam, slack, own)
    # in the worst case every pair of a chunk is a hit; a graph is searched by as many queries as it takes at a time
    size = max(1, min(CHUNK, CELLS // len(g.x))) if wide is None else together(len(g.x))
    for lo in range(0, len(q), size):
        part = q[lo : lo + size]
        yield lo, _brute(g.x, part, least) if wide is None else g.within(part, least, *wide)


def _query(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Rows (u, v, n, by): a tree's edge (n null), or the links that u found (by false) or that found u (by true)."""
    if graphs.empty or queries.empty:
        return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="Int64"), "n": pd.Series(dtype="Int64"), "by": pd.Series(dtype="bool")})
    g, exact, cls, m = _load(graphs["graph"].iloc[0])
    queries = queries.sort_values("cls")
    own, q = _unit(queries["embedding"], queries["dim"].iloc[0])
    ids, weight = queries["cls"].to_numpy(), queries["m"].to_numpy()
    place = pd.Series(np.arange(len(cls)), index=cls).reindex(ids).fillna(-1).to_numpy(np.int64)
    both = np.unique(np.concatenate([ids, cls]))
    of_query, of_node, labels = np.searchsorted(both, ids), np.searchsorted(both, cls), np.arange(len(both))
    out, back = np.zeros(len(ids), np.int64), np.zeros(len(cls), np.int64)
    for lo, (who, node, sim) in search(g, q, LEAST - NEAR, own=place):
        who = who + lo
        close = np.flatnonzero(np.abs(sim - LEAST) <= NEAR)
        ok = sim >= LEAST
        for a in range(0, len(close), 100_000):
            c = close[a : a + 100_000]
            ok[c] = np.einsum("kd,kd->k", own[who[c]], exact[node[c]]) >= LEAST
        ok &= ids[who] != cls[node]
        who, node = who[ok], node[ok]
        out += np.bincount(who, weights=m[node], minlength=len(ids)).astype(np.int64)
        back += np.bincount(node, weights=weight[who], minlength=len(cls)).astype(np.int64)
        link(labels, of_query[who], of_node[node])
    child, f, r = np.flatnonzero(labels != np.arange(len(both))), np.flatnonzero(out), np.flatnonzero(back)
    none = [None] * (len(f) + len(r))
    return pd.DataFrame({"u": np.concatenate([both[child], ids[f], cls[r]]), "v": pd.array([*both[labels[child]], *none], dtype="Int64"), "n": pd.array([*[None] * len(child), *out[f], *back[r]], dtype="Int64"), "by": np.repeat([False, False, True], [len(child), len(f), len(r)])})


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """Per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Null vectors, those with a null or non-finite component, empty ones and zero ones
    link with nothing: they are their own component and are kept. Vectors of different
    lengths don't link. Rows with equal vectors link with each other whatever their
    ids; a null id gives no component id of its own and isn't kept. Other columns are
    ignored; an empty table gives an empty one.
    """
    types = {f.name: f.dataType for f in vectors.schema}
    kind = "<f4" if isinstance(types["embedding"].elementType, FloatType) else "<f8"
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = written(arrow_map(numbered, _packed(kind), f"row long, vec_id {types['vec_id'].simpleString()}, embedding binary", NARROW_ROWS), "vectors")
    classes = written(rows.filter("embedding is not null").groupBy("embedding").agg(F.min("row").alias("cls"), F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("dim", (F.length("embedding") / int(kind[-1])).cast("int")), "classes")
    total, dim = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards, blocks = max(SHARDS, -(-total // min(SHARD_SIZE, max(1, SHARD_BYTES // (8 * dim))))), max(1, -(-total // BLOCK_SIZE))
    dealt = classes.select("dim", F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int").alias("shard"), "cls", "m", "embedding")
    graphs = written(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, graph binary"), "graphs")
    per_block = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(shards * blocks, "dim", "shard", "block").groupBy("dim", "shard", "block")
    asked = classes.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "cls", "m", "embedding").repartition(shards * blocks, "dim", "shard", "block").groupBy("dim", "shard", "block")
    found = written(per_block.cogroup(asked).applyInPandas(_query, "u long, v long, n long, by boolean"), "links")
    counts = found.filter("v is null").groupBy(F.col("u").alias("cls")).agg(F.greatest(F.sum(F.when(F.col("by"), 0).otherwise(F.col("n"))), F.sum(F.when(F.col("by"), F.col("n")).otherwise(0))).alias("n"))
    roots = components(found.filter("v is not null").select("u", "v")).select(F.col("node").alias("cls"), "root")
    rooted = classes.select("cls", "m", "least").join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = written(rooted.withColumnRenamed("n", "links"), "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    of_class = met(rooted, ids, "root").select("cls", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id", F.col("m").alias("n"))
    known = written(of_class.join(classes.select("cls", "embedding"), "cls"), "known")
    none = F.lit(None).cast("long")
    out = met(rows, known, "embedding").select("vec_id", "n_links", "component_id", F.lit(False).alias("alone"))
    out = out.unionByName(rows.filter("embedding is null").select("vec_id", none.alias("n_links"), none.alias("component_id"), F.lit(True).alias("alone")))
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

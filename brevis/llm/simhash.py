"""SimHash near-duplicates, found through an inverted index on byte positions with count filtering.

Two 64-bit fingerprints with at most three differing bits share at least five of
their eight bytes at the same position: five is the guaranteed minimum of matches.
An index on single bytes has postings of n/256 rows each, whose pairs grow with the
square of n, so a posting is kept for four positions together. The fourteen blocks
of the Steiner system S(3,4,8), the quadruples of 0..7 with XOR zero, hold every
triple of positions, and the complement of a block is a block: wherever the three
differing bytes lie, some block is shared whole. A posting is posted again, within
its task, under each of its other four bytes. Two members that meet in none of
these have a tally of four and are never compared; those that meet in k of them
have a tally of 4 + k, reach the minimum, and are verified by counting differing
bits. Only a spanning forest of a posting's links leaves the task.

A posting with more than HOT members is not held in memory: its members stream
out and are posted again under five positions by a shuffle. There 24 bits remain, so
that a posting has 2**24 members at most, and links are found through a table of
those bits. Both ways compare the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, arrow_map, met, written
from .graph import components

SEED = 42
WORDS = 3
MAX_BITS = 3
#: Postings up to this size are compared pair by pair.
HOT = 2048
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
FIVES = list(combinations(range(8), 5))


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash; 0 for null, empty or blank texts."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    counts, n = np.zeros(64, np.int64), len(words) - WORDS + 1
    for lo in range(0, n, 1 << 18):
        hi = min(n, lo + (1 << 18))
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[lo:hi], ends[lo + WORDS - 1 : hi + WORDS - 1], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x) for x in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row; text_hash tells apart rows that share an id."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return arrow_map(narrow, _hash_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


def _byte(col: Column, p: int) -> Column:
    return F.shiftrightunsigned(col, 8 * p).bitwiseAND(F.lit(255))


def _key(number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number << 40)
    for j, p in enumerate(positions):
        key = key.bitwiseOR(F.shiftleft(_byte(F.col("fp"), p), 8 * j))
    return key


def link(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j in labels, each node's label being the smallest in its tree."""
    while i.size:
        a, b = labels[i], labels[j]
        keep = a != b
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while not np.array_equal(labels, nxt := labels[labels]):
            labels[:] = nxt


def _pairwise(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Labels after linking the close pairs of every run of equal keys, met through postings on a further byte."""
    labels, bytes_ = np.arange(len(key)), fp.view(np.uint8).reshape(-1, 8)
    block = np.array(BLOCKS)[key >> 40]  # the positions that a run shares already
    for p in range(8):
        own = np.flatnonzero((block != p).all(1))
        if own.size < 2:
            continue
        posting = key[own] * 256 + bytes_[own, p]  # keys take 44 bits
        order = np.argsort(posting, kind="stable")
        own, posting = own[order], posting[order]
        i, d = np.arange(len(own) - 1), 1
        while i.size:
            i = i[i + d < len(own)]
            i = i[posting[i] == posting[i + d]]
            ok = np.bitwise_count(fp[own[i]] ^ fp[own[i + d]]) <= MAX_BITS
            link(labels, own[i[ok]], own[i[ok] + d])
            d += 1
    return labels


def _by_table(key: int, fp: np.ndarray) -> np.ndarray:
    """The same for one run under five positions: every change of at most three of the 24 other bits is looked up."""
    rest = [p for p in range(8) if p not in FIVES[key >> 40]]
    value = sum(((fp >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * j) for j, p in enumerate(rest))
    at, labels, own = np.full(1 << 24, -1, np.int32), np.arange(len(fp)), np.arange(len(fp))
    at[value] = own
    for bits in range(1, MAX_BITS + 1):
        for flip in combinations(range(24), bits):
            other = at[value ^ sum(1 << b for b in flip)]
            ok = other > own
            link(labels, own[ok], other[ok].astype(np.int64))
    return labels


def _postings(hot: int | None):
    """Arrow function over rows sorted by key: links (hot false), and the members of larger runs (hot true, v the key)."""

    def out(u, v, is_hot):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), is_hot))], names=["u", "v", "hot"])

    def closed(key, fp):
        if len(key) > HOT and hot is None:
            cuts = np.flatnonzero(np.diff(key)) + 1
            runs = zip([0, *cuts], [*cuts, len(key)], strict=True)
        else:
            runs = [(0, len(key))]
        for a, b in runs:
            labels = _by_table(int(key[a]), fp[a:b]) if hot is None else _pairwise(key[a:b], fp[a:b])
            child = np.flatnonzero(labels != np.arange(b - a))
            if child.size:
                yield out(fp[a:b][child], fp[a:b][labels[child]], False)

    def run(batches):
        held, streaming = [], None  # the rows of the last key so far, as they came
        for batch in batches:
            k, f = np.array(batch.column("key")), np.array(batch.column("fp")).view(np.uint64)
            if streaming is not None:
                n = int(np.searchsorted(k, streaming, side="right"))
                if n:
                    yield out(f[:n], k[:n], True)
                k, f = k[n:], f[n:]
                if not k.size:
                    continue
                streaming = None
            if held and k[-1] == held[0][0][-1]:
                held.append((k, f))
            else:
                key, fp = (np.concatenate(c) for c in zip(*held, (k, f), strict=True))
                last = int(np.searchsorted(key, key[-1], side="left"))
                if last:
                    if hot is not None:
                        for a, b in _large(key[:last], hot):
                            yield out(fp[a:b], key[a:b], True)
                        small = _small(key[:last], hot)
                        yield from closed(key[:last][small], fp[:last][small])
                    else:
                        yield from closed(key[:last], fp[:last])
                held = [(key[last:], fp[last:])]
            if hot is not None and sum(len(x) for x, _ in held) > hot:
                streaming = held[0][0][-1]
                for x, y in held:
                    yield out(y, x, True)
                held = []
        if held:
            yield from closed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(key)) + 1 if key.size else np.empty(0, np.int64)
    return (np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])) if key.size else (cuts, cuts)


def _large(key: np.ndarray, hot: int) -> list[tuple[int, int]]:
    a, b = _runs(key)
    big = b - a > hot
    return list(zip(a[big], b[big], strict=True))


def _small(key: np.ndarray, hot: int) -> np.ndarray:
    a, b = _runs(key)
    return np.repeat((b - a <= hot) & (b - a > 1), b - a)


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fps(fp long, distinct) -> (u, v), links that connect the same fingerprints as all pairs within MAX_BITS do."""
    posted = fps.select("fp", F.explode(F.array(*[_key(n, b) for n, b in enumerate(BLOCKS)])).alias("key"))
    found = written(arrow_map(posted.repartition("key").sortWithinPartitions("key", "fp"), _postings(hot), "u long, v long, hot boolean", NARROW_ROWS), "postings")
    again = F.array(*[F.when(F.expr(f"array_contains(array({', '.join(str(n) for n, b in enumerate(BLOCKS) if set(b) < set(five))}), shiftright(v, 40))"), _key(m, five)) for m, five in enumerate(FIVES)])
    finer = found.filter("hot").select(F.col("u").alias("fp"), "v").select("fp", F.explode(F.filter(again, lambda k: k.isNotNull())).alias("key"))
    more = arrow_map(finer.repartition("key").sortWithinPartitions("key", "fp"), _postings(None), "u long, v long, hot boolean", NARROW_ROWS)
    return found.filter("not hot").select("u", "v").unionAll(more.select("u", "v"))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, fp long, component_id, root long) of every row of docs(doc_id, text); root is equal within a component.

    Rows with null, empty or blank text have fingerprint zero and link like any
    other; rows without an id take part but give no component id of their own (a
    component of such rows only has a null id); repeated rows come out as often as
    they came in; other columns are ignored; an empty table gives an empty one.
    Rows with equal fingerprints meet in a grouping that combines before the
    shuffle, so copies cost one posting however many there are, and the rows of a
    fingerprint or component that is hot stay where they are in the joins back.
    """
    return _grouped(written(fingerprints(docs), "fingerprints"), hot)


def _grouped(marked: DataFrame, hot: int = HOT) -> DataFrame:
    """marked(fp, doc_id, ...) with component_id and root."""
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    fps = written(fps, "distinct")
    roots = components(links(fps.select("fp"), hot))
    rooted = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("n").alias("rows")), "roots")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    named = written(met(rooted, ids, "root").select("fp", "component_id", "root", F.col("rows").alias("n")), "named")
    return met(marked, named, "fp").select(*marked.columns, "component_id", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the smallest id (rows without one come last), then the smallest text hash, then the smallest hash of the other columns.

    Rows with null, empty or blank text are one component, of which one row stays.
    Of rows that are equal in every column one stays. No column is added or lost,
    whatever the names; an empty table gives an empty one.
    """
    columns = docs.columns
    packed = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in columns]).alias("whole")), "packed")
    rest = [F.col("whole").getField(c).alias(f"c{i}") for i, c in enumerate(columns) if c not in ("doc_id", "text")]
    other = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    order = F.struct(F.col("whole.doc_id").isNull().alias("late"), F.col("whole.doc_id").alias("doc_id"), F.xxhash64("whole.text").alias("text_hash"), other.alias("other"), "row").alias("place")
    marked = written(arrow_map(packed.select("row", F.col("whole.doc_id").alias("doc_id"), order, F.col("whole.text").cast("binary").alias("text")), _hash_batches, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, place {_type(packed.select(order))}, fp long"), "fingerprints")
    best = _grouped(marked).groupBy("root").agg(F.min("place").alias("best")).select(F.col("best.row").alias("row"))
    return packed.join(best, "row", "left_semi").select([F.col("whole").getField(c).alias(c) for c in columns])


def _type(one: DataFrame) -> str:
    return one.dtypes[0][1]

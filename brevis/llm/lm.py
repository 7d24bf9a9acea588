"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs, seated by Gibbs sampling.

Every word, and the end of a text, has a context restaurant whose dishes are the
words that follow it; all of them share one parent, whose customers are their
tables, over a uniform distribution of the vocabulary and an unseen word. No word
and no pair is left out or merged with others.

A Gibbs step takes all customers of one dish out of one restaurant and seats them
again, given everybody else. Their seating is drawn from its exact conditional: the
number of tables t of c customers has the odds S(c, t) times the odds of opening t
tables, where S are the generalised Stirling numbers, which count the seatings. With
a discount of one half these have a closed form at every size, so that a dish of two
customers and one of a billion are seated by the same rule. The dishes of a
restaurant are bound together by its number of tables alone; given a rate, drawn
from that number, they are independent, so that they are seated wherever they lie. A
pair seen once has one table and is never drawn. Parents stand still while their
children are seated, and follow. Tables and the parent's probabilities are averaged
over the kept sweeps, which leaves a distribution.

Where things lie: the pairs of the FREQUENT commonest words are an array, so that no
hot pair is shuffled. All other tokens are dealt to buckets by their context, or by
the pair where the context is one of these, packed in blocks. What a bucket must know
of other words are arrays for about the KNOWN commonest; for all others it meets in joins.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, crc_mod, written

#: Words whose pairs are an array, words known to every task, and tokens a bucket: where things lie, not what comes out.
FREQUENT = 1024
KNOWN = 1 << 18
BUCKET = 1 << 19
FOLDS, HELD = 7, 2
#: The closed form below needs this discount.
DISCOUNT, STRENGTH = 0.5, 1.0
#: Sweeps of the sampler, and how many of the last ones are averaged.
SWEEPS, KEPT, SEED = 6, 3, 11
#: Up to so many customers the odds are summed.
FEW = 8
#: Words that a task counts before it hands their counts on.
COUNTED = 400_000
#: Texts in a batch that is dealt: its words are held at once.
DEAL_ROWS = 128
#: Parts in which buckets are scored, one after the other, as each shuffles its tokens; a log10 probability's unit between buckets.
PARTS, UNIT = 2, 2.0**-30
#: The end of a text, as a word: words are never empty.
END = b""
#: Rows about a bucket: a block of tokens, one of its cells (pairs met twice or more), one of their tables; customers beyond the first of a table by word (n; contexts as -1 - u); a word it must know of; that word's probability.
TOKENS, CELLS, TABLES, EXCESS, NEED, GIVEN = range(6)
ROW = "bucket int, kind int, key long, n long, p double, blob binary"


def tokens(data: bytes | None) -> list[bytes]:
    return [*(data or b"").lower().split(), END]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

    c: Counter = Counter()
    for b in batches:
        for data, train in zip(b.column("text").to_pylist(), b.column("train").to_pylist(), strict=True):
            if train:
                c.update(tokens(data))
            else:
                c.update(dict.fromkeys(tokens(data), 0))
        if len(c) > COUNTED:
            yield rows(c)
            c = Counter()
    yield rows(c)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one block, byte planes apart, compressed."""
    a = np.ascontiguousarray(np.stack(columns).astype(np.int64))
    planes = a.view(np.uint8).reshape(*a.shape, 8).transpose(0, 2, 1)
    return a.shape[0].to_bytes(4, "little") + a.shape[1].to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(block: bytes) -> np.ndarray:
    k, n = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:12], "little")
    planes = np.frombuffer(pa.decompress(block[12:], decompressed_size=k * n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(k, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(k, n)


def _rows(bucket: int, kind: int, key=None, n=None, p=None, blob=None) -> pa.Table:
    size = len(next(x for x in (key, blob) if x is not None))
    own = [pa.array(np.full(size, bucket), pa.int32()), pa.array(np.full(size, kind), pa.int32())]
    types = (pa.int64(), pa.int64(), pa.float64(), pa.binary())
    return pa.Table.from_arrays([*own, *(pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip((key, n, p, blob), types, strict=True))], names=["bucket", "kind", "key", "n", "p", "blob"])


def _of(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


class Place(dict):
    """Numbers of words: of known ones, from 1, by their place; of others 60 bits of a digest, above all places. The end is 0."""

    def __init__(self, known: list[bytes], salt: int):
        super().__init__({w: i for i, w in enumerate(known, 1)} | {END: 0})
        self.prefix = b"%d " % salt

    def __missing__(self, word: bytes) -> int:
        return (int.from_bytes(hashlib.md5(self.prefix + word).digest()[:8], "big") >> 4) + (1 << 60)


def _id_column(salt: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(b"%d " % salt), F.col("word"))), 1, 15), 16, 10).cast("long") + F.lit(1 << 60)


def _deal(u: np.ndarray, w: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    mixed = np.where(u > hot, u, u * 1_000_003 + w * 8_191).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(31)) % np.uint64(buckets)).astype(np.int64)


DEALT = "row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base_score double, hot binary, bucket int, blob binary, cell long, c long"


def _deal_batches(shared):
    """Per text its figures, as far as known words tell, and its pairs of frequent words; counts of these pairs in training; per bucket blocks of all other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hot, buckets, schema = shared.value
        place = m.place()
        c = np.array([*m.numbers(), 0], np.int64)
        base = np.log10((c + 1) / (m.total + m.vocabulary + 1))
        base[-1] = 0.0  # of words beyond the known ones the buckets tell
        cells, held, first = np.zeros((hot + 1) ** 2, np.int64), [], None

        def record(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def blocks() -> Iterator[pa.RecordBatch]:
            u, w, r = np.concatenate(held, axis=1)
            held.clear()
            to = _deal(u, w, hot, buckets)
            order = np.lexsort((u, to))
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            found = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            for lo in range(0, len(found), 64):
                some = found[lo : lo + 64]
                yield record(len(some), row=[first] * len(some), bucket=some, blob=[pack(np.diff(x[0], prepend=0), *x[1:]) for x in (np.stack([y[order[edges[b] : edges[b + 1]]] for y in (u, w, r)]) for b in some)])

        for b in batches:
            if not b.num_rows:
                continue
            words, lens = [], []
            for data in b.column("text").to_pylist():
                own = tokens(data)
                words += own
                lens.append(len(own))
            w, lens = np.fromiter(map(place.__getitem__, words), np.int64, len(words)), np.array(lens)
            starts = np.cumsum(lens) - lens
            u = np.concatenate([[0], w[:-1]])  # the end of one text is the context of the next one's first word
            at = np.minimum(w, len(c) - 1)
            train, rows = b.column("train").to_numpy(zero_copy_only=False).astype(bool), b.column("row").to_numpy()
            both = (u <= hot) & (w <= hot)
            code = u[both] * (hot + 1) + w[both]
            text = np.repeat(np.arange(len(lens)), lens)
            np.add.at(cells, code[train[text[both]]], 1)
            ends = np.searchsorted(text[both], np.arange(len(lens) + 1))
            code = code.astype(np.int32)
            yield record(b.num_rows, row=b.column("row"), doc_id=b.column("doc_id"), held_out=b.column("held_out"), n_tokens=lens, n_known=np.add.reduceat((c[at] > 0).astype(np.int64), starts),
                         base_score=np.add.reduceat(base[at], starts), hot=[code[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)])
            if not both.all():
                first = int(rows[0]) if first is None else first
                held.append(np.stack([u[~both], w[~both], (rows[text[~both]] - first) * 2 + train[text[~both]]]))
                if sum(x.shape[1] for x in held) > BUCKET:
                    yield from blocks()
                    first = None
        if held:
            yield from blocks()
        at = np.flatnonzero(cells)
        for lo in range(0, len(at), 20_000):
            some = at[lo : lo + 20_000]
            yield record(len(some), cell=some, c=cells[some])

    return run


def _paired(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a bucket; the order of their tokens by pair, each one's pair in that order, and context and word of every pair."""
    parts = [unpack(x) for x in _of(table, TOKENS).column("blob").to_pylist()]
    u, w = np.concatenate([np.cumsum(x[0]) for x in parts]), np.concatenate([x[1] for x in parts])  # contexts come as differences
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
    return parts, order, np.cumsum(new) - 1, u[new], w[new]


def _counted(parts: list[np.ndarray], order: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """How often each pair is met in training."""
    train = np.concatenate([x[2] for x in parts])[order] & 1
    return np.bincount(pair, weights=train).astype(np.int64)


def _by(key: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(key, return_inverse=True)
    return kinds, np.bincount(at, weights=weights, minlength=len(kinds)).astype(np.int64)


def _excess(bucket: int, u: np.ndarray, w: np.ndarray, beyond: np.ndarray, hot: int) -> list[pa.Table]:
    words, n = _by(w, beyond)
    spread = u <= hot
    contexts, k = _by(u[spread], beyond[spread])
    return [_rows(bucket, EXCESS, key=words, n=n), _rows(bucket, EXCESS, key=-1 - contexts, n=k)]


def _count_bucket(hot: int, known: int):
    def run(key, table):
        bucket = key[0].as_py()
        parts, order, pair, u, w = _paired(table)
        c = _counted(parts, order, pair)
        _, at = np.unique(u, return_inverse=True)
        customers = np.bincount(at, weights=c).astype(np.int64)[at]
        rare = np.unique(w[w > known])
        out = [_rows(bucket, NEED, key=rare)]
        many = c > 1
        if many.any():
            t = np.ones(int(many.sum()), np.int64)
            out += [_rows(bucket, CELLS, blob=[pack(u[many], w[many], c[many], customers[many])]), _rows(bucket, TABLES, blob=[pack(t, 0 * t)]), *_excess(bucket, u[many], w[many], c[many] - 1, hot)]
            # singles of a context that has cells are among its customers; other contexts have nothing to draw
        return pa.concat_tables(out)

    return run


def _given(table: pa.Table, w: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The parent's probability of each word: of known ones from an array, of others from what was sent."""
    sent = _of(table, GIVEN)
    key, p = sent.column("key").to_numpy(), sent.column("p").to_numpy()
    order = np.argsort(key)
    out = common[np.minimum(w, len(common) - 1)]
    rare = w >= len(common)
    if rare.any():
        out[rare] = p[order][np.searchsorted(key[order], w[rare])]
    return out


def _seat_bucket(shared, sweep: int, kept: bool):
    def run(key, table):
        bucket, (common, rates, hot) = key[0].as_py(), shared.value
        rng = np.random.default_rng((SEED, sweep, bucket))
        u, w, c, customers = unpack(_of(table, CELLS).column("blob")[0].as_py())
        t, total = unpack(_of(table, TABLES).column("blob")[0].as_py())
        own, at = np.unique(u, return_inverse=True)
        tables = np.zeros(len(own), np.int64)
        tables[at] = customers
        tables = tables - np.bincount(at, weights=c - t).astype(np.int64)
        spread = own <= hot
        x = np.zeros(len(own))
        x[~spread] = rate(rng, tables[~spread])
        x[spread] = rates[own[spread]]
        t = seat_at_rate(rng, c, x[at] * _given(table, w, common))
        return pa.concat_tables([_rows(bucket, TABLES, blob=[pack(t, total + t * kept)]), *_excess(bucket, u, w, c - t, hot)])

    return run


def _score_bucket(shared):
    def run(key, table):
        common, customers, seats, hot, whole = shared.value
        parts, order, pair, u, w = _paired(table)
        c = _counted(parts, order, pair)
        t = np.minimum(c, 1).astype(float)
        if (c > 1).any():
            t[c > 1] = unpack(_of(table, TABLES).column("blob")[0].as_py())[1] / KEPT  # cells lie in the order of pairs
        _, at = np.unique(u, return_inverse=True)
        n, tables = np.bincount(at, weights=c)[at], np.bincount(at, weights=t)[at]
        spread = u <= hot
        n[spread], tables[spread] = customers[u[spread]], seats[u[spread]]
        logp = np.empty(len(order))
        logp[order] = np.log10(_predictive(c, t, n, tables, _given(table, w, common)))[pair]
        met, base = np.zeros(len(order), np.int64), np.zeros(len(order))
        rare = w >= len(common)
        if rare.any():
            sent = _of(table, GIVEN)
            key, number = sent.column("key").to_numpy(), sent.column("n").to_numpy()
            by = np.argsort(key)
            own = np.zeros(len(w), np.int64)
            own[rare] = number[by][np.searchsorted(key[by], w[rare])]
            met[order] = (own > 0)[pair]
            base[order] = np.where(rare, np.log10((own + 1) / whole), 0.0)[pair]
        ends, blocks = np.cumsum([x.shape[1] for x in parts]), []
        for x, end in zip(parts, ends, strict=True):
            at = x[2] >> 1
            rows = np.flatnonzero(np.bincount(at))
            known, lower, score = (np.bincount(at, weights=v[end - x.shape[1] : end])[rows] for v in (met, base, logp))
            blocks.append(pack(rows, known.astype(np.int64), lower.view(np.int64), np.rint(score / UNIT).astype(np.int64)))
        return pa.table({"first": _of(table, TOKENS).column("key"), "blob": pa.array(blocks, pa.binary())})

    return run


def _sum_blocks(key, table):
    first, parts = key[0].as_py(), [unpack(x) for x in table.column("blob").to_pylist()]
    whole = np.concatenate(parts, axis=1)
    rows, at = np.unique(whole[0], return_inverse=True)
    return pa.table({"row": rows + first, "k": np.bincount(at, weights=whole[1]).astype(np.int64), "b": np.bincount(at, weights=whole[2].view(np.float64)), "s": np.bincount(at, weights=whole[3].astype(float)) * UNIT})


def _hot_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for b in batches:
            codes = b.column("hot").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([float(logp[np.frombuffer(x, np.int32)].sum()) for x in codes], pa.float64())], names=[*b.schema.names[:-1], "score"])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    steps = np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    y = x + 8.0
    r = 1.0 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(steps)


def log_odds(t: np.ndarray, c: np.ndarray, base: np.ndarray, tables: np.ndarray | None) -> np.ndarray:
    """Unnormalised log probability that c customers of a dish sit at t tables.

    base: the parent's probability of the dish; tables: of the other dishes in the restaurant.
    Without tables, base is that probability times the restaurant's `rate`.
    """
    seatings = log_gamma(2 * c - t) - log_gamma(c - t + 1) - log_gamma(t) - 2 * (c - t) * np.log(2.0)
    if tables is None:
        return seatings + t * np.log(DISCOUNT * base)
    others = STRENGTH / DISCOUNT + tables
    return seatings + log_gamma(others + t) - log_gamma(others) + t * np.log(DISCOUNT * base)


def rate(rng: np.random.Generator, tables: np.ndarray) -> np.ndarray:
    """A draw of a restaurant's rate from its number of tables.

    The dishes of a restaurant depend on each other through gamma(STRENGTH / DISCOUNT +
    tables) alone, which is the integral of x ** (STRENGTH / DISCOUNT + tables - 1) *
    exp(-x). Given x, the rate, they are independent of each other and seated at once, wherever they lie.
    """
    return rng.gamma(STRENGTH / DISCOUNT + np.asarray(tables, np.float64))


def _mode(n: np.ndarray, base: np.ndarray, tables: np.ndarray | None) -> np.ndarray:
    """The likeliest number of tables: odds rise up to the root of a quadratic."""
    each, others = (0.0, DISCOUNT) if tables is None else (DISCOUNT, STRENGTH + DISCOUNT * tables)
    a = 1 - 4 * base * each
    b, c = 4 * base * (n * each - others) - 2 * n + 1, 4 * base * n * others
    t = np.clip(np.floor(2 * c / np.maximum(np.sqrt(np.maximum(b * b - 4 * a * c, 0)) - b, 1e-300)) + 1, 1, n)
    rising = lambda t: 4 * (n - t + 1) * (others + each * (t - 1)) * base >= (t - 1) * (2 * n - t)  # noqa: E731  the odds of t are no less than those of t - 1
    t = np.where((t < n) & rising(np.minimum(t + 1, n)), t + 1, t)  # rounding is mended
    return np.where((t > 1) & ~rising(t), t - 1, t)


def seat_at_rate(rng: np.random.Generator, c: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A draw of the number of tables per dish, given base: rate times the parent's probability. Up to FEW customers the odds are summed."""
    out = np.minimum(c, 1).astype(np.int64)
    few, many = np.flatnonzero((c > 1) & (c <= FEW)), np.flatnonzero(c > FEW)
    if few.size:
        n, h, p = c[few].astype(np.float64), base[few].astype(np.float64), np.ones(few.size)
        upto = [p]
        for t in range(1, int(n.max())):
            p = p * (4 * DISCOUNT * h * np.maximum(n - t, 0) / (np.maximum(2 * n - t - 1, 1) * t))
            upto.append(upto[-1] + p)
        u = rng.random(few.size) * upto[-1]
        out[few] = np.minimum(1 + sum((u >= x).astype(np.int64) for x in upto[:-1]), c[few])
    out[many] = seat(rng, c[many], base[many], None)
    return out


def seat(rng: np.random.Generator, c: np.ndarray, base: np.ndarray, tables: np.ndarray | None) -> np.ndarray:
    """A draw of the number of tables per dish, each of another restaurant (without tables, see log_odds).

    The odds are log-concave in t, so they lie below a plateau around the mode and,
    beyond a place on either side, below the exponential slope from the mode through
    that place; draws from this hull are accepted with the right odds, which makes them exact.
    """
    out = np.minimum(c, 1).astype(np.int64)
    at = np.flatnonzero(c > 1)
    if not at.size:
        return out
    n, h, s = c[at].astype(np.float64), base[at].astype(np.float64), None if tables is None else tables[at].astype(np.float64)
    mode = _mode(n, h, s)
    top = log_odds(mode, n, h, s)
    curve = 1 / (n - mode + 1) + 1 / mode - (0.0 if s is None else DISCOUNT / (STRENGTH + DISCOUNT * (s + mode))) - 1 / (2 * n - mode)
    reach = np.ceil(1.4 / np.sqrt(np.maximum(curve, 1e-12))) + 1
    right, left = np.minimum(mode + reach, n + 1), np.maximum(mode - reach, 0)  # n + 1 and 0 can't be
    fall_r = np.where(right <= n, (top - log_odds(np.minimum(right, n), n, h, s)) / (right - mode), 800.0)
    fall_l = np.where(left >= 1, (top - log_odds(np.maximum(left, 1), n, h, s)) / np.maximum(mode - left, 1), 800.0)
    flat = right - left - 1
    slope_r = np.where(right <= n, np.exp(-fall_r * (right - mode)) / -np.expm1(-fall_r), 0.0)
    slope_l = np.where(left >= 1, np.exp(-fall_l * (mode - left)) / -np.expm1(-fall_l), 0.0)
    live, got = np.arange(len(n)), mode.copy()
    while live.size:
        m, k, f, r, w = mode[live], n[live], flat[live], slope_r[live], slope_l[live]
        u = rng.random(live.size) * (f + r + w)
        tail = -np.log(1 - rng.random(live.size))
        go_r, go_l = (u >= f) & (u < f + r), u >= f + r
        t = np.where(go_r, right[live] + np.floor(tail / fall_r[live]), np.where(go_l, left[live] - np.floor(tail / fall_l[live]), left[live] + 1 + np.minimum(np.floor(u), f - 1)))
        inside = (t >= 1) & (t <= k)
        t = np.clip(t, 1, k)
        hull = np.where(go_r, -fall_r[live] * (t - m), np.where(go_l, -fall_l[live] * (m - t), 0.0))
        ok = inside & (np.log(1 - rng.random(live.size)) <= log_odds(t, k, h[live], None if s is None else s[live]) - top[live] - hull)
        got[live[ok]] = t[ok]
        live = live[~ok]
    out[at] = got
    return out


@dataclass
class Words:
    counts: dict[bytes, int]  # of the KNOWN commonest words, the commonest first, and of the end
    total: int
    vocabulary: int
    kinds: dict[int, int]  # of all words: how many have a count
    least: int  # count of the rarest known words
    salt: int

    def place(self) -> Place:
        return Place([w for w in self.counts if w != END], self.salt)

    def numbers(self) -> list[int]:
        return [self.counts.get(END, 0), *(c for w, c in self.counts.items() if w != END)]


def _predictive(c, t, customers, tables, parent):
    return (np.maximum(c - DISCOUNT * t, 0) + (STRENGTH + DISCOUNT * tables) * parent) / (STRENGTH + customers)


def sample_pairs(c: np.ndarray, sweeps: int = SWEEPS, kept: int = KEPT, seed: int = SEED) -> np.ndarray:
    """Averaged P(symbol | context) from pair counts (context x symbol)."""
    rng, size = np.random.default_rng(seed), c.shape[1]
    customers, uniform = c.sum(1).astype(float), 1.0 / size
    by_dish = [(np.flatnonzero(c[:, w]), c[:, w][c[:, w] > 0].astype(np.int64)) for w in range(size)]
    t, average = (c > 0).astype(np.int64), np.zeros(c.shape)
    tables, root_t = t.sum(1), (t.sum(0) > 0).astype(np.int64)
    for sweep in range(sweeps):
        guests = t.sum(0)
        for w in np.flatnonzero(guests):  # the parent: one dish after the other
            others = root_t.sum() - root_t[w]
            root_t[w] = seat(rng, guests[w : w + 1], np.full(1, uniform), np.full(1, others))[0]
        root = _predictive(guests, root_t, guests.sum(), root_t.sum(), uniform)
        for w, (ctx, n) in enumerate(by_dish):  # one dish of every context at a time
            if ctx.size:
                tables[ctx] -= t[ctx, w]
                t[ctx, w] = seat(rng, n, np.full(len(ctx), root[w]), tables[ctx])
                tables[ctx] += t[ctx, w]
        if sweep >= sweeps - kept:
            average += _predictive(c, t, customers[:, None], tables[:, None], root[None, :])
    return average / kept


def sample_rare(counts: np.ndarray, words: np.ndarray, sweeps: int = SWEEPS, kept: int = KEPT, seed: int = SEED) -> np.ndarray:
    """Averaged P(word | rare) by count; the last one is of an unseen word. words: how many words have the count.

    Words of one count have the same odds, so all of them are seated at once: how many
    sit at one table, at two, and so on is one multinomial draw.
    """
    rng = np.random.default_rng(seed)
    total, kinds = float((counts * words).sum()), float(words.sum())
    base, sums, average = 1.0 / (kinds + 1), words.astype(float).copy(), np.zeros(len(counts) + 1)
    for sweep in range(sweeps):
        for i, (c, n) in enumerate(zip(counts, words, strict=True)):
            if c > 1:
                others = sums.sum() - sums[i] / n
                sums[i] = _seat_alike(rng, int(c), int(n), base, others)
        if sweep >= sweeps - kept:
            average += _predictive(np.append(counts, 0.0), np.append(sums / words, 0.0), total, sums.sum(), base)
    return average / kept


def _seat_alike(rng: np.random.Generator, c: int, n: int, base: float, others: float | None) -> float:
    """The tables of n words with c customers each, together."""
    top = float(_mode(np.float64(c), base, others))
    odds = lambda t: log_odds(np.asarray(t, float), float(c), base, others)
    peak, reach = odds(top), 8
    while (low := max(1, top - reach)) > 1 and odds(low) > peak - 45 or (high := min(c, top + reach)) < c and odds(high) > peak - 45:
        reach *= 2
    t = np.arange(low, min(c, top + reach) + 1)  # beyond, all together weigh less than 1e-17
    p = np.exp(odds(t) - peak)
    return float((rng.multinomial(n, p / p.sum()) * t).sum())


def fit(docs: DataFrame, train: Column | None = None) -> tuple[Words, DataFrame]:
    """The words, and the table word -> c of all training tokens; c is 0 of words met in other rows alone."""
    texts = docs.select(F.col("text").cast("binary").alias("text"), (F.lit(True) if train is None else train).alias("train"))
    counts = _written(arrow_map(texts, _count_batches, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    trained = counts.filter("c > 0")
    total, vocabulary = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    kinds = trained.filter(F.length("word") > 0).groupBy("c").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values("c", ascending=False)  # counts differ: at most the root of twice the tokens
    fits = np.flatnonzero(kinds["n"].cumsum().to_numpy() <= KNOWN)
    least = int(kinds["c"].iloc[fits[-1]]) if fits.size else total + 1
    top = trained.filter((F.length("word") == 0) | (F.col("c") >= least)).toArrow().to_pandas()  # KNOWN rows and the end: a filter, no sort
    top["word"] = [bytes(w) for w in top["word"]]
    top = top.sort_values(["c", "word"], ascending=[False, True])
    known = dict(zip(top["word"].tolist(), top["c"].tolist(), strict=True))
    rare, salt = counts.filter((F.length("word") > 0) & (F.col("c") < least)), 0
    while not rare.groupBy(_id_column(salt).alias("key")).count().filter("count > 1").isEmpty():
        salt += 1  # two words shared a number
    n = Counter(dict(zip(kinds["c"].tolist(), kinds["n"].tolist(), strict=True)))
    if END in known:
        n[known[END]] += 1
    return Words(known, int(total), int(vocabulary), dict(n), least, salt), counts


class Parent:
    """The shared restaurant. Words of one number of customers have the same odds: all of them are seated at once, and share the mean of their tables."""

    def __init__(self, m: Words):
        self.rng, self.base, self.tables = np.random.default_rng(SEED), 1.0 / (m.vocabulary + 1), float(m.vocabulary)

    def follow(self, guests: np.ndarray, words: np.ndarray) -> None:
        odds = float(rate(self.rng, self.tables)) * self.base
        sums = words.astype(float)
        few = (words <= 64) & (guests > 1)
        each = np.repeat(np.flatnonzero(few), words[few])
        sums[few] = np.bincount(each, weights=seat_at_rate(self.rng, guests[each], np.full(len(each), odds)), minlength=len(words))[few]
        for i in np.flatnonzero((words > 64) & (guests > 1)):
            sums[i] = _seat_alike(self.rng, int(guests[i]), int(words[i]), odds, None)
        self.guests, self.mean, self.tables, self.all = guests, sums / words, float(sums.sum()), float((guests * words).sum())

    def probability(self, guests: np.ndarray) -> np.ndarray:
        """Of a word with so many guests, 0 being the unseen one."""
        mean = np.zeros(len(guests))
        if len(self.guests):
            mean = np.where(guests > 0, self.mean[np.minimum(np.searchsorted(self.guests, guests), len(self.guests) - 1)], 0.0)
        return _predictive(guests, mean, self.all, self.tables, self.base)


def _collected(df: DataFrame, size: int, key: str, value: str) -> np.ndarray:
    out, rows = np.zeros(size, np.int64), df.toArrow()
    out[rows.column(key).to_numpy()] = rows.column(value).to_numpy()
    return out


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """written(), whose shuffle files go when it is stored."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, tag, *by)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def _drop(df: DataFrame) -> None:
    """Delete a written table that a later one has replaced."""
    files = df.inputFiles()
    if files:
        root, name = files[0].rsplit("/brevis/", 1)
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/brevis/{name.split('/')[0]}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _part(df: DataFrame, kind: int, **columns) -> DataFrame:
    """Rows about buckets, with the columns that df lacks null."""
    own = {"bucket": F.col("bucket"), "kind": F.lit(kind)} | columns
    return df.select(*(own.get(name, F.lit(None)).cast(kind_of).alias(name) for name, kind_of in (x.split() for x in ROW.split(", "))))


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id) mod 7 isn't 2; a null id is neither held
    out nor learned from. A null or empty text is its end alone. With no training
    text every token is unknown, and the unseen word has all of the probability.
    Repeated rows are learned from and come out as often as they came in; other
    columns are ignored; an empty table gives an empty one.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    fold = crc_mod(F.col("doc_id"), FOLDS)
    train = F.coalesce(fold != HELD, F.lit(False))
    m, counts = fit(docs, train)
    number = np.array(m.numbers(), np.int64)
    known, hot, buckets = len(number) - 1, min(FREQUENT, len(number) - 1), m.total // BUCKET + 1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(fold == HELD, F.lit(False)).alias("held_out"), train.alias("train"), F.col("text").cast("binary").alias("text"))
    layout = DEALT.format(dict(docs.dtypes)["doc_id"])
    schema = to_arrow_schema(spark.createDataFrame([], layout).schema)
    dealt = _written(arrow_map(rows, _deal_batches(sc.broadcast((m, hot, buckets, schema))), layout, DEAL_ROWS), "dealt")
    blocks = _part(dealt.filter("bucket is not null"), TOKENS, key=F.col("row"), blob=F.col("blob"))
    first = _written(blocks.groupBy("bucket").applyInArrow(_count_bucket(hot, known), ROW), "cells", "kind")
    array = _collected(dealt.filter("cell is not null").groupBy("cell").agg(F.sum("c").alias("c")), (hot + 1) ** 2, "cell", "c")  # at most FREQUENT squared numbers
    rare = counts.filter((F.length("word") > 0) & (F.col("c") < m.least)).select(_id_column(m.salt).alias("key"), "c")

    # the sampler: cells of the buckets there, those of frequent words here
    at = np.flatnonzero(array)
    u, w, c = at // (hot + 1), at % (hot + 1), array[at]
    t, t_sum, seats, common_sum = np.minimum(c, 1), np.zeros(len(c)), np.zeros(hot + 1), np.zeros(known + 1)
    excess = lambda state: state.filter(F.col("kind") == EXCESS)
    far_keys = excess(first).filter(F.col("key") > known).select("key").distinct()
    far = _written(rare.join(far_keys, "key").select("key", "c", F.col("c").alias("g"), F.lit(0.0).alias("p")), "far")
    histogram = lambda col: {r[0]: r[1] for r in far.groupBy(col).count().collect()}  # noqa: E731  numbers differ: at most the root of twice the tokens
    others = Counter(m.kinds)
    others.subtract(Counter(number[number > 0].tolist()))
    others.subtract(histogram("c"))
    parent, state, unseen, alone = Parent(m), first.filter(F.col("kind").isin(TABLES, EXCESS)), 0.0, np.array(sorted(k for k, v in others.items() if v > 0), np.int64)
    alone_sum = np.zeros(len(alone))

    def beyond() -> tuple[np.ndarray, np.ndarray]:
        """Customers of the known words and of the frequent contexts beyond the first of each table."""
        sums = _collected(excess(state).filter(F.col("key") <= known).groupBy("key").agg(F.sum("n").alias("n")).select((F.col("key") + hot + 1).alias("key"), "n"), known + hot + 2, "key", "n")
        words, contexts = sums[hot + 1 :], sums[: hot + 1][::-1]
        words[: hot + 1] += np.bincount(w, weights=c - t, minlength=hot + 1).astype(np.int64)
        return words, contexts + np.bincount(u, weights=c - t, minlength=hot + 1).astype(np.int64)

    by_word, by_context = beyond()
    stored = far
    for sweep in range(SWEEPS):
        kept = sweep >= SWEEPS - KEPT
        sums = excess(state).filter(F.col("key") > known).groupBy("key").agg(F.sum("n").alias("n"))
        far, old = _written(far.join(sums, "key").select("key", "c", (F.col("c") - F.col("n")).alias("g"), "p"), "far"), stored
        stored = far
        _drop(old)
        guests = Counter(others)
        guests.update((number - by_word)[number > 0].tolist())
        guests.update(histogram("g"))
        kinds = np.array(sorted(k for k, v in guests.items() if v > 0), np.int64)
        parent.follow(kinds, np.array([guests[k] for k in kinds.tolist()], np.int64))
        common = parent.probability(number - by_word)
        rates = rate(parent.rng, number[: hot + 1] - by_context)
        table = spark.createDataFrame(pa.table({"g": kinds, "f": parent.probability(kinds)}))
        told = far.join(F.broadcast(table), "g")
        given = excess(state).filter(F.col("key") > known).select("bucket", "key").join(told, "key")
        shared = sc.broadcast((common, rates, hot))
        seen = first.filter(F.col("kind") == CELLS).unionByName(state.filter(F.col("kind") == TABLES)).unionByName(_part(given, GIVEN, key=F.col("key"), p=F.col("f")))
        state, old = _written(seen.groupBy("bucket").applyInArrow(_seat_bucket(shared, sweep, kept), ROW), "seats", "kind"), state
        if sweep:
            _drop(old)
        t = seat_at_rate(parent.rng, c, rates[u] * common[w])
        by_word, by_context = beyond()
        if kept:
            far = told.select("key", "c", "g", (F.col("p") + F.col("f")).alias("p"))
            t_sum += t
            seats += number[: hot + 1] - by_context
            common_sum += common
            alone_sum += parent.probability(alone)
            unseen += float(parent.probability(np.zeros(1, np.int64))[0])

    # scores
    common, seats, customers, t = common_sum / KEPT, seats / KEPT, number[: hot + 1], t_sum / KEPT
    grid, mean = np.zeros((hot + 1) ** 2), np.zeros((hot + 1) ** 2)
    grid[at], mean[at] = c, t
    logp = np.log10(_predictive(grid.reshape(hot + 1, -1), mean.reshape(hot + 1, -1), customers[:, None], seats[:, None], common[None, : hot + 1])).ravel()
    table = F.broadcast(spark.createDataFrame(pa.table({"c": alone, "f": alone_sum / KEPT})))
    learned = rare.join(table, "c", "left").join(far.select("key", (F.col("p") / KEPT).alias("p")), "key", "left").select("key", "c", F.coalesce("p", "f", F.lit(unseen / KEPT)).alias("p"))
    learned = _written(learned, "learned")
    needed = first.filter(F.col("kind") == NEED).select("bucket", "key").join(learned, "key")
    whole = blocks.unionByName(state.filter(F.col("kind") == TABLES)).unionByName(_part(needed, GIVEN, key=F.col("key"), n=F.col("c"), p=F.col("p")))
    shared = sc.broadcast((common, customers, seats, hot, m.total + m.vocabulary + 1))
    parts = min(PARTS, buckets)
    scored = [_written(whole.filter(F.col("bucket") % parts == k).groupBy("bucket").applyInArrow(_score_bucket(shared), "first long, blob binary"), "blocks") for k in range(parts)]
    cold = reduce(DataFrame.unionByName, scored).groupBy("first").applyInArrow(_sum_blocks, "row long, k long, b double, s double")
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    plain = arrow_map(dealt.filter("n_tokens is not null").select(*names, "hot"), _hot_batches(sc.broadcast(logp)), ", ".join(x for x in layout.split(", ") if x.split()[0] in names) + ", score double")
    zero = F.lit(0)
    return plain.join(cold, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )

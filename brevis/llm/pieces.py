"""Sampled segmentations over a SentencePiece vocabulary, by forward filtering and backward sampling.

Text is cut before each run of spaces and around each line feed, which no piece
crosses, so a text's lattice is a chain of small lattices, one per cut word, and
filtering them apart is exact. For every distinct word of a batch the forward sums
of the piece weights are computed once; every occurrence then walks back from the
word's end, choosing the piece that ends there with its share of the forward sum.
All occurrences of a batch take a step together. The draws come from a counter
keyed by the row's id and the place in the text, so a row is segmented alike in
any batch, partition or retry.

Characters outside the vocabulary are written as byte pieces, and so is a literal
U+2581, which would otherwise read as a space: decoding gives back the bytes.
"""

from __future__ import annotations

import importlib
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: File of the production vocabulary, a parameter of every function here; in the folder of the installed public_tokenizers.
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A piece of rank r weighs (r + SHIFT) ** -POWER: the file ranks pieces but has no probabilities.
SHIFT, POWER = 2.7, 1.0
#: The weight of a character that is written as bytes.
BYTES = 1e-5
#: Words of more characters are filtered one by one.
LONG = 48
#: Characters of a long word that are looked up at once; bytes of the texts that share a lattice.
BLOCK, TOGETHER = 1 << 16, 1 << 20
BASE = np.uint64(0x100000001B3)
POWERS = [np.uint64(pow(0x100000001B3, k, 2**64)) for k in range(64)]
#: Longer pieces are looked for only where the last TAIL characters end one.
TAIL = 5
SLOTS, MULTIPLIERS = 19, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
WORD = re.compile(r" *[^ \n]+|\n| +")


def model_path(name: str = MODEL) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c)) % 2**64
    return h ^ (len(piece) * 0xC2B2AE3D27D4EB4F % 2**64)


def _slots(left: dict[int, int]) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """Hash tables in which every key has a slot: in the first one, or else in a later one."""
    out = []
    for turn in MULTIPLIERS:
        keys, values, rest = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32), {}
        for h, i in left.items():
            at = (h * turn % 2**64) >> (64 - SLOTS)
            if values[at] < 0:
                keys[at], values[at] = h, i
            else:
                rest[h] = i
        out.append((np.uint64(turn), keys, values))
        left = rest
    if left:
        raise ValueError("the hash tables of the pieces are too small")
    return [x for x in out if (x[2] >= 0).any()]


def _look_up(slots, prefix: np.ndarray, size: int) -> np.ndarray:
    """Values of the strings with these polynomial hashes and this many characters; -1 where there is none."""
    h, out = prefix ^ np.uint64(size * 0xC2B2AE3D27D4EB4F % 2**64), None
    for turn, keys, values in slots:
        at = (h * turn) >> np.uint64(64 - SLOTS)
        got = np.where(keys[at] == h, values[at], -1)
        out = got if out is None else np.maximum(out, got)
    return out


@dataclass
class Vocabulary:
    ids: dict[str, int]
    pieces: list[bytes]  # what each id stands for, with spaces
    weight: np.ndarray
    byte_ids: list[int]
    longest: int

    def __post_init__(self):
        self.slots = _slots({_hash(p): i for p, i in self.ids.items()})
        self.tails = _slots({_hash(p[-TAIL:]): 0 for p in self.ids if len(p) > TAIL})
        self.of_byte = np.array(self.byte_ids, np.int32)
        self.tail_set = {p[-TAIL:] for p in self.ids if len(p) > TAIL}
        self.weights = self.weight.tolist()

    def decode(self, ids) -> bytes:
        """The text's bytes; the leading space that encoding adds is taken off again."""
        p = self.pieces
        return b"".join([p[i] for i in ids])[1:]


@cache
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, pieces, byte_ids = {}, [], [0] * 256
    weight = np.zeros(len(model))
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        pieces.append(b"")
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces[i] = bytes([int(piece[3:5], 16)])
            weight[i] = (len(model) + SHIFT) ** -POWER
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece crosses a space; words can't be cut there")
            pieces[i] = piece.replace(SPACE, " ").encode()
            ids[piece.replace(SPACE, " ")] = i
            weight[i] = (-model.get_score(i) + SHIFT) ** -POWER
    return Vocabulary(ids, pieces, weight, byte_ids, max(map(len, ids)))


class Lattices:
    """Forward-filtered lattices of distinct words: a row per (place in a word, word), a column per piece length.

    cum holds the cumulated shares of the pieces that end at a place, ids their
    ids (bytes of a character without a piece: minus its code, less one). Words are
    ordered by falling length, so that those with a p-th place are the first ones and
    a layer is filtered for all words at once.
    """

    def __init__(self, vocab: Vocabulary, words: list[str]):
        v, w = vocab, vocab.longest
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        sizes = np.array([len(words[i]) for i in order], np.int64)
        top = int(sizes[0]) if len(words) else 0
        held = np.searchsorted(-sizes, -np.arange(top + 2), side="right")  # words with a place p
        self.base = np.concatenate([[0], np.cumsum(held[1 : top + 1])])  # of layer p at p - 1
        rows = int(self.base[-1])
        self.cum, self.ids = np.zeros((rows, w), np.float32), np.zeros((rows, w), np.int32)
        long, short = 0, [words[i] for i in order]
        if not short:
            return
        chars = np.array(short, dtype=f"U{max(1, int(sizes[long]))}").view(np.uint32).reshape(len(short), -1).T.astype(np.uint64)
        prefix, forward = [np.zeros(len(short), np.uint64)], [np.ones(len(short))]
        for p in range(1, int(sizes[long]) + 1):
            n = int(held[p]) - long
            prefix.append(prefix[-1][:n] * BASE + chars[p - 1, :n])
            lo = int(self.base[p - 1]) + long
            cum, ids, total, parts = self.cum[lo : lo + n], self.ids[lo : lo + n], np.zeros(n), []
            some = None
            for k in range(1, min(p, w) + 1):
                if k <= TAIL:
                    ids[:, k - 1] = got = _look_up(v.slots, prefix[p] - prefix[p - k][:n] * POWERS[k], k)
                    total = total + np.where(got >= 0, forward[p - k][:n] * v.weight[got], 0.0)
                else:
                    if some is None:
                        some = np.flatnonzero(_look_up(v.tails, prefix[p] - prefix[p - TAIL][:n] * POWERS[TAIL], TAIL) >= 0)
                        total = total.copy() if some.size else total
                    if some.size:
                        got = _look_up(v.slots, prefix[p][some] - prefix[p - k][some] * POWERS[k], k)
                        hit = some[got >= 0]
                        if hit.size:
                            got = got[got >= 0]
                            ids[hit, k - 1] = got
                            total = total.copy()
                            total[hit] += forward[p - k][hit] * v.weight[got]
                parts.append(total)
            none = np.flatnonzero(total == 0)
            if none.size:
                lone = forward[p - 1][none] * BYTES
                for part in parts:  # total is the last
                    part[none] = lone  # a part may be the same array as another
                ids[none, 0] = -1 - chars[p - 1, none].astype(np.int32)
            for k, part in enumerate(parts):
                cum[:, k] = part / total
            cum[:, len(parts) - 1 :] = 1.0
            forward.append(total)


class LongWord:
    """A word of any length, filtered forward in log space: one number per character is held.

    The pieces that end at a place are looked up by blocks of BLOCK characters on the
    way forward, and one place at a time on the way back.
    """

    def __init__(self, vocab: Vocabulary, word: str):
        self.v, self.word = vocab, word
        self.log = array("d", [0.0])
        log, weight, lone = self.log, vocab.weight, math.log(BYTES)
        for lo in range(0, len(word), BLOCK):
            place, size, piece = self._ends(lo, min(len(word), lo + BLOCK))
            at, n, wants = 0, len(place), weight[piece].tolist()
            for p in range(lo + 1, min(len(word), lo + BLOCK) + 1):
                last, total = log[p - 1], 0.0
                while at < n and place[at] == p:
                    total += wants[at] * math.exp(log[p - size[at]] - last)
                    at += 1
                log.append(last + (math.log(total) if total else lone))

    def _ends(self, lo: int, hi: int) -> tuple[list[int], list[int], np.ndarray]:
        """(place, size, id) of the pieces that end at lo + 1 .. hi, by place and size."""
        v, back = self.v, max(0, lo - self.v.longest + 1)
        chars = np.frombuffer(self.word[back:hi].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, own, places, sizes, ids = np.zeros(len(chars) + 1, np.uint64), None, [], [], []
        for k in range(1, min(v.longest, len(chars)) + 1):
            h = h[:-1] * BASE + chars[k - 1 :]  # h[i] is of the k characters from i on
            at = np.arange(len(h)) if k <= TAIL or own is None else own[own >= 0]
            at = at[at + k + back > lo] if k <= TAIL else at
            got = _look_up(v.slots, h[at], k)
            hit = got >= 0
            places.append(at[hit] + k + back)
            sizes.append(np.full(int(hit.sum()), k))
            ids.append(got[hit])
            if k == TAIL:  # longer pieces are looked for only where their last characters end one
                own = np.arange(len(h))[_look_up(v.tails, h, k) >= 0]
            if k >= TAIL:
                own = own - 1
        place, size, piece = (np.concatenate(x) for x in (places, sizes, ids))
        keep = place > lo
        place, size, piece = place[keep], size[keep], piece[keep]
        order = np.lexsort((size, place))
        return place[order].tolist(), size[order].tolist(), piece[order]

    def sample(self, counter: np.uint64) -> np.ndarray:
        """Ids of one segmentation, drawn backwards."""
        v, word, log, out, p, draws, step = self.v, self.word, self.log, array("i"), len(self.word), None, 0
        while p > 0:
            if step % BLOCK == 0:
                draws = _mix(counter + np.arange(step, step + BLOCK).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).tolist()
            found, total = [], 0.0
            for k in range(1, min(p, v.longest) + 1):
                if k == TAIL + 1 and word[p - TAIL : p] not in v.tail_set:
                    break
                i = v.ids.get(word[p - k : p], -1)
                if i >= 0:
                    total += v.weights[i] * math.exp(log[p - k] - log[p - 1])
                    found.append((total, k, i))
            if found:
                want = draws[step % BLOCK] * total
                _, k, i = next((x for x in found if x[0] > want), found[-1])
            else:
                k, i = 1, -1 - ord(word[p - 1])
            out.append(i)
            p -= k
            step += 1
        return np.array(out, np.int32)[::-1]


def _mix(x: np.ndarray) -> np.ndarray:
    """Uniform draws from counters (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def seed_of(key) -> int:
    return xxhash.xxh64_intdigest(repr(key).encode())


def encode(texts: list[bytes], seeds: list[int], vocab: Vocabulary) -> list[np.ndarray]:
    """Piece ids of each text."""
    own = [WORD.findall(" " + t.decode("utf-8", "surrogateescape")) for t in texts]
    words = list(dict.fromkeys(chain.from_iterable(own)))
    words.sort(key=lambda w: len(w) > LONG)  # the short ones first
    short = sum(len(w) <= LONG for w in words)
    number = {w: i for i, w in enumerate(words)}
    lattices, per = Lattices(vocab, words[:short]), np.array([len(o) for o in own], np.int64)
    which = np.fromiter(map(number.__getitem__, chain.from_iterable(own)), np.int64, int(per.sum()))
    place = np.array([len(w) if len(w) <= LONG else 0 for w in words], np.int64)[which]
    rank = np.append(lattices.rank, np.zeros(len(words) - short, np.int64))[which]
    at = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)  # of the word in its text
    counter = np.repeat(np.array(seeds, np.uint64), per) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    long = np.flatnonzero(which >= short)
    spelt = _long_words(vocab, words, which[long], counter[long])
    live, steps = np.flatnonzero(which < short), []
    while live.size:
        row = lattices.base[place[live] - 1] + rank[live]
        draw = _mix(counter[live] + np.uint64(len(steps) * 0xD1B54A32D192ED03 % 2**64)).astype(np.float32)
        size = (lattices.cum[row] <= np.minimum(draw, np.float32(0.99999994))[:, None]).sum(1)
        steps.append((live, lattices.ids[row, size]))
        place[live] -= size + 1
        live = live[place[live] > 0]
    sizes = np.zeros(len(which), np.int64)
    for who, _ in steps:
        sizes[who] += 1
    sizes[long] = [len(x) for x in spelt]
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.int32)
    for k, (who, got) in enumerate(steps):
        out[ends[who] - 1 - k] = got
    for i, ids in zip(long.tolist(), spelt, strict=True):
        out[ends[i] - len(ids) : ends[i]] = ids
    plain = (out < 0) & (out >= -128)
    out[plain] = vocab.of_byte[-1 - out[plain]]
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])]
    return [_with_bytes(out[a:b], vocab) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _long_words(vocab: Vocabulary, words: list[str], which: np.ndarray, counter: np.ndarray) -> list[np.ndarray]:
    """Segmentations of occurrences of long words; each word is filtered once, and only one is held at a time."""
    out: list = [None] * len(which)
    order = np.argsort(which, kind="stable")
    held = None
    for i in order.tolist():
        if held is None or held[0] != which[i]:
            held = (which[i], LongWord(vocab, words[which[i]]))
        out[i] = held[1].sample(counter[i])
    return out


def _with_bytes(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    if not (ids < 0).any():
        return ids
    spelt = [[i] if i >= 0 else [vocab.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogateescape")] for i in ids.tolist()]
    return np.array([i for p in spelt for i in p], np.int32)


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most TOGETHER bytes, or of one row."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > TOGETHER:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _encode_batches(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path(name))
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            got = []
            for lo, hi in _runs([len(t or b"") for t in texts]):
                got += encode([t or b"" for t in texts[lo:hi]], [seed_of(k) for k in keys[lo:hi]], vocab)
            rows = [None if t is None else ids for t, ids in zip(texts, got, strict=True)]
            same = [None if ids is None else vocab.decode(ids.tolist()) == t for t, ids in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([None if r is None else len(r) for r in rows], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "lossless"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, ids array<int>, n_pieces long, lossless boolean (decoding gave the text back).

    A null text has null ids; an empty one has the single piece of the leading
    space. A null id is a key like any other, so rows that share an id and a text
    are segmented alike. Other columns are ignored; an empty table gives an empty one.
    """
    return arrow_map(docs.select("doc_id", F.col("text").cast("binary").alias("text")), _encode_batches(model), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, n_pieces long, lossless boolean", 700)


def _decode_batches(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path(name))
        for b in batches:
            texts = [None if r is None else vocab.decode(r) for r in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text).

    Null ids give a null text, the ids of an empty text an empty one. Bytes that aren't
    UTF-8 come back as they were. Repeated rows come out as often as they came in; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = arrow_map(encoded.select("doc_id", "ids"), _decode_batches(model), f"doc_id {dict(encoded.dtypes)['doc_id']}, text binary")
    return rows.withColumn("text", F.col("text").cast("string"))

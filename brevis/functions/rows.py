"""Text rules that carry state along a document or a string, as Arrow UDFs over plain Python functions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _udf(f: Callable, returns: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else f(x))

    return lambda c: F.pandas_udf(run, returns)(c)


# --- sentences of a document -------------------------------------------------

# fixed values: patterns of sentences that go
_OPENERS = (re.compile(r"By [A-Z]"), re.compile(r"^\("), re.compile(r"c\.\d"))
_ALWAYS = (re.compile(r"eds:", re.I), re.compile(r"[ -]\d{3}-\d{4}"), re.compile(r"\(k\)"))
_QUOTE_START, _QUOTE_END, _QUOTE_BOTH = re.compile(r'(^|\s)[\(]*"'), re.compile(r"\"[,.'\)]*(\s|$)"), re.compile(r"([^\(\s]\"[^\s.,'])")


def _shouts(s: str) -> bool:
    return s.isupper() or sum(c.isupper() for c in s) > 0.2 * max(len(s), 1)


def keep_sentences(sentences: list[str]) -> list[str]:
    """Drops bylines and the like while nothing was kept yet; always drops shouting, short sentences without an end, notes to editors and phone numbers."""
    kept: list[str] = []
    for s in sentences:
        if not kept and (any(p.search(s) for p in _OPENERS) or s[:1] == '"' and s[-1:] == '"'):
            continue
        ended = s.endswith((".", '."', ".)"))
        if _shouts(s) or len(s.split()) < 20 and not ended or any(p.search(s) for p in _ALWAYS):
            continue
        kept.append(s)
    return kept


def glue_quotes(sentences: list[str]) -> list[str]:
    """Joins the sentences between a quotation's start and the nearest end after it; of starts with one end the nearest has it, others are left alone."""
    starts, ends, offset = [], [], 0  # (place in the text, sentence)
    for k, s in enumerate(sentences):
        starts += [(offset + m.end(), k) for p in (_QUOTE_START, _QUOTE_BOTH) for m in p.finditer(s)]
        ends += [(offset + m.start(), k) for p in (_QUOTE_END, _QUOTE_BOTH) for m in p.finditer(s)]
        offset += len(s)
    ends.sort()
    nearest: dict[int, tuple[int, int]] = {}  # end -> the last start before it
    for place, k in sorted(starts):
        e = bisect_left(ends, (place, -1))
        if e < len(ends) and (e not in nearest or nearest[e][0] < place):
            nearest[e] = (place, k)
    joined = {i for e, (_, first) in nearest.items() for i in range(first + 1, ends[e][1] + 1)}
    out: list[str] = []
    for i, s in enumerate(sentences):
        if i in joined:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


# --- tokens ------------------------------------------------------------------

_CLITICS = re.compile(r"(?i)(?<=\w)('s|'m|'d|'ll|'re|'ve|n't)\b")
_MARKS = re.compile(r"\.\.\.|--|[][(){}<>,;:@#$%&?!]")
_FIXED = (("cannot", "can not"), ("gonna", "gon na"), ("gotta", "got ta"), ("wanna", "wan na"))


def treebank_tokens(s: str) -> list[str]:
    """Punctuation apart, directed quotes, clitics apart, and a final period apart from its word."""
    s = re.sub(r'(^|[\s(\[{<])"', r"\1`` ", s)
    s = s.replace('"', " '' ")
    s = _MARKS.sub(lambda m: f" {m.group()} ", s)
    s = re.sub(r"([^.\s])(\.)([\])}>\"']*)\s*$", r"\1 \2\3 ", s)
    s = _CLITICS.sub(r" \1", s)
    for whole, parts in _FIXED:
        s = re.sub(rf"(?i)\b{whole}\b", parts, s)
    return s.split()


def detokenize(tokens: list[str]) -> str:
    """Roughly undoes treebank_tokens: marks back to their words, straight quotes."""
    s = " ".join(tokens)
    s = re.sub(r"`` ?", '"', s)
    s = re.sub(r" ?''", '"', s)
    s = re.sub(r" ('s|'m|'d|'ll|'re|'ve|n't)\b", r"\1", s)
    s = re.sub(r" ([.,;:?!%)\]}])", r"\1", s)
    s = re.sub(r"([(\[{$#]) ", r"\1", s)
    return s.replace("can not", "cannot")


# --- strings -----------------------------------------------------------------


def string_similarity(a: str, b: str) -> float:
    """Longest common substrings are matched and removed, longest first; sqrt of the sum of (2 x length)^2 over both lengths."""
    n, total = len(a) + len(b), 0
    if not n:
        return 0.0
    left, right = [a], [b]
    for size in range(min(len(a), len(b)), 0, -1):
        found = True
        while found:
            found = False
            for i, x in enumerate(left):
                for p in range(len(x) - size + 1):
                    j = next((j for j, y in enumerate(right) if x[p : p + size] in y), None)
                    if j is not None:
                        q = right[j].index(x[p : p + size])
                        left[i : i + 1] = [x[:p], x[p + size :]]
                        right[j : j + 1] = [right[j][:q], right[j][q + size :]]
                        total += (2 * size) ** 2
                        found = True
                        break
                if found:
                    break
    return total**0.5 / n


def syllables(word: str) -> int:
    """Vowel groups, a silent final e aside; one at least."""
    w = re.sub(r"[^a-z]", "", word.lower())
    w = w[:-1] if w.endswith("e") and not w.endswith("le") else w
    return max(1, len(re.findall("[aeiouy]+", w))) if w else 0


def huffman_codes(weights: dict[str, float]) -> dict[str, str]:
    """Prefix codes by falling weight; symbols break ties."""
    import heapq

    heap = [(w, s, {s: ""}) for s, w in sorted(weights.items())]
    heapq.heapify(heap)
    if len(heap) == 1:
        return {next(iter(weights)): "0"}
    while len(heap) > 1:
        (wa, sa, a), (wb, sb, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (wa + wb, min(sa, sb), {s: "0" + c for s, c in a.items()} | {s: "1" + c for s, c in b.items()}))
    return heap[0][2] if heap else {}


def huffman_encode(symbols: list[str], codes: dict[str, str]) -> str:
    """Symbols without a code are an error."""
    return "".join(codes[s] for s in symbols)


def huffman_decode(bits: str, codes: dict[str, str]) -> list[str]:
    """No code starts another, so the first that fits is the symbol; bits left over at the end are an error."""
    symbol, out, at = {c: s for s, c in codes.items()}, [], ""
    for bit in bits:
        at += bit
        if at in symbol:
            out.append(symbol[at])
            at = ""
    if at:
        raise ValueError(f"{at} is the start of a code only")
    return out


KEEP, GLUE = (_udf(lambda x, f=f: f(list(x)), "array<string>") for f in (keep_sentences, glue_quotes))
TREEBANK, DETOKENIZE = _udf(treebank_tokens, "array<string>"), _udf(lambda x: detokenize(list(x)), "string")


def kept_sentences(sentences: Column) -> Column:
    return KEEP(GLUE(sentences))


def treebank(s: Column) -> Column:
    return TREEBANK(s)


def detokenized(tokens: Column) -> Column:
    return DETOKENIZE(tokens)

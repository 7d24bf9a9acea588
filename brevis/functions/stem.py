"""Suffix-stripping stemmer after Porter (1980), with the extensions that the production rules use.

Rules are tables of (suffix, replacement); a step applies its longest matching
suffix. On tables, distinct words are stemmed and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("fulli", "ful"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


# Words whose stems no rule gives.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}


def _shape(word: str) -> str:
    """v or c per letter; y is a consonant at the start and after a vowel."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or a two-letter vowel and consonant."""
    s = _shape(word)
    return s[-3:] == "cvc" and word[-1] not in "wxy" or s == "vc"


def _longest(word: str, table) -> tuple[str, str] | None:
    fits = [(a, b) for a, b in table if word.endswith(a)]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _derived(w: str) -> str:
    hit = _longest(w, STEP2)
    if hit and _measure(w[: -len(hit[0])]) > 0:
        w = w[: -len(hit[0])] + hit[1]
        return _derived(w) if hit[0] == "alli" else w
    if not hit and w.endswith("logi") and _measure(w[:-3]) > 0:
        return w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Lower-cased; words of two letters or fewer stay, irregular ones are looked up."""
    w = word.lower()
    if len(w) <= 2 or w in IRREGULAR:
        return IRREGULAR.get(w, w)
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _derived(w)
    hit = _longest(w, STEP3)
    if hit and _measure(w[: -len(hit[0])]) > 0:
        w = w[: -len(hit[0])] + hit[1]
    hit = _longest(w, [(s, "") for s in STEP4])
    if hit:
        base = w[: -len(hit[0])]
        if _measure(base) > 1 and (hit[0] != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _series(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for words in batches:
        yield words.map(stem, na_action="ignore")


def _arrays(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for rows in batches:
        yield rows.map(lambda ws: [stem(w) for w in ws], na_action="ignore")


def stem_column(words: Column) -> Column:
    return F.pandas_udf(_series, "string")(words)


def stem_arrays(words: Column) -> Column:
    """Arrays of words; a worker remembers the commonest words' stems."""
    return F.pandas_udf(_arrays, "array<string>")(words)


def stem_content(words: Column, stop: tuple[str, ...], least: int = 3) -> Column:
    """The 2008 rule: stopwords, "said" among them, and words of fewer than `least` letters stay as they are."""
    kept = frozenset(stop) | {"said"}

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield arrays.map(lambda ws: [w if len(w) < least or w in kept else stem(w) for w in ws], na_action="ignore")

    return F.pandas_udf(rows, "array<string>")(words)


def stem_table(words: DataFrame, column: str = "word") -> DataFrame:
    """(column, stem) of the distinct words: each goes to Python once, whatever its frequency."""
    return words.select(column).distinct().withColumn("stem", stem_column(F.col(column)))

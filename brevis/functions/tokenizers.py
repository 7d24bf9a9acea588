"""Tokenizers by pattern, as Column expressions, and one for bracketed expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import _udf
from .text import ngrams


def by_whitespace(s: Column) -> Column:
    return F.filter(F.split(s, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")


def by_space(s: Column) -> Column:
    """Between single spaces; empty tokens stay."""
    return F.split(s, " ")


def by_tab(s: Column) -> Column:
    return F.split(s, "\t")


def by_line(s: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(s, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) != "")


def by_blank_line(s: Column) -> Column:
    return F.filter(F.split(s, "\\s*\\n\\s*\\n\\s*"), lambda x: x != "")


def word_punctuation(s: Column) -> Column:
    """Runs of word characters, and runs of other marks."""
    return F.regexp_extract_all(s, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\x0B\\f\\r]+"), F.lit(0))


def words_only(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def _bracketed(s: str) -> list[str]:
    out, depth, at, start = [], 0, 0, 0
    for i, c in enumerate(s):
        if c == "(":
            if depth == 0:
                out += s[at:i].split()
                start = i
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if depth == 0:
                out.append(s[start : i + 1])
                at = i + 1
    return out + (s[at:].split() if depth == 0 else [s[start:]])


BRACKETED = _udf(_bracketed, "array<string>")


def bracketed(s: Column) -> Column:
    """Top-level (...) expressions whole, and the words between them; an expression that never closes runs to the end."""
    return BRACKETED(s)


def regexp_stem(word: Column, pattern: str = "ing$|s$|e$|able$", least: int = 4) -> Column:
    """What the pattern matches, taken off words of `least` letters or more."""
    return F.when(F.length(word) >= least, F.regexp_replace(word, pattern, "")).otherwise(word)


def first_replaced(s: Column, pattern: str, new: str) -> Column:
    """The first match of a pattern without groups replaced, the rest left as it is."""
    parts = F.split(s, pattern, 2)
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), F.lit(new), F.get(parts, F.lit(1)))).otherwise(s)


def shown(s: Column, pattern: str) -> Column:
    """Matches in braces."""
    return F.regexp_replace(s, f"({pattern})", "{$1}")


def clean_url(url: Column) -> Column:
    """Host and path in lower case: scheme, user, port, www., query, fragment and a final slash left out."""
    x = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", "")
    x = F.regexp_replace(F.regexp_replace(x, "[?#].*$", ""), "^[^/@]*@", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^([^/:]*):[0-9]+", "$1"), "^www[.]", ""), "/$", "")


def alnum_bigrams(words: Column) -> Column:
    """Neighbours among the words that have a letter or a digit."""
    return ngrams(F.filter(words, lambda x: x.rlike("[a-zA-Z0-9]")), 2)


#: Names of days from Monday on.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def grounded(phrase: Column, anchor: Column) -> Column:
    """The date that a phrase means when said on anchor: an ISO date, yesterday, today, tomorrow, last or next week, month or year, a weekday (the next one, or the one before with last); null for others."""
    p = F.lower(F.btrim(phrase, F.lit(" ")))
    day = F.array_position(F.array(*map(F.lit, DAYS)), F.element_at(F.split(p, " "), -1)).cast("int")
    now = F.weekday(anchor) + 1
    ahead = F.when(day > now, day - now).otherwise(day - now + 7)
    back = F.when(day < now, now - day).otherwise(now - day + 7)
    out = F.when(p.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(p, "yyyy-MM-dd"))
    out = out.when(p == "yesterday", F.date_sub(anchor, 1)).when(p == "today", F.to_date(anchor)).when(p == "tomorrow", F.date_add(anchor, 1))
    for word, n in (("last", -1), ("next", 1)):
        out = out.when(p == f"{word} week", F.date_add(anchor, 7 * n)).when(p == f"{word} month", F.add_months(anchor, n)).when(p == f"{word} year", F.add_months(anchor, 12 * n))
    return out.when((day > 0) & p.startswith("last "), F.date_sub(anchor, back)).when(day > 0, F.date_add(anchor, ahead))

"""Scalar text functions on built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\f\x0b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often and within whatever lambdas use has it: Spark computes an expression wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def remove_tags(s: Column) -> Column:
    """Without <...>, white space squeezed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), "\\s+", " "))


#: All but ASCII letters, digits, hyphens and spaces, listed: Java's matcher is several times slower on the negated class.
NOT_WORDS = "[\\x00-\\x1f!-,./:-@\\[-`{-\\x{10ffff}]+"


def remove_punct(s: Column) -> Column:
    """Only ASCII letters, digits, hyphens and spaces stay; tabs and line feeds vanish too."""
    return F.trim(F.regexp_replace(s, NOT_WORDS, ""))


def is_punct(s: Column) -> Column:
    return ~s.rlike("[a-zA-Z0-9]")


def fix_text(s: Column) -> Column:
    """remove_punct, then spaces squeezed, then lower case."""
    return F.lower(F.regexp_replace(remove_punct(s), "  +", " "))


def word_tokens(s: Column) -> Column:
    """Tokens of text that has passed remove_punct: a leading hyphen and a run of hyphens between words stand alone."""
    lead = lambda x: F.regexp_replace(x, "((^| )-)([^-])", "$1 $3")  # noqa: E731  twice, since matches can't overlap
    apart = lambda x: F.regexp_replace(lead(lead(x)), "([^-])(--+)([^-])", "$1 $2 $3")
    runs = let(s, lambda x: F.when(F.contains(x, F.lit("-")), apart(x)).otherwise(x))
    return F.array_remove(F.split(runs, " +"), "")


def tokenize(s: Column) -> Column:
    return word_tokens(fix_text(s))


def split_sentences(s: Column) -> Column:
    """Rule-based: a line feed ends a sentence, and so do . ! ? before blanks. Empty ones are left out."""
    broken = F.regexp_replace(s, "([.!?])[ \\t\\r\\f]+", "$1\n")
    return F.filter(F.transform(F.split(broken, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def n_words(s: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(s, F.lit("\\S+"))


def ngrams(words: Column, n: int, bounds: bool = False) -> Column:
    """Runs of n words joined by _; none if there are fewer. bounds: with a start and an end marker around the words."""
    w = F.concat(F.array(F.lit("<start>")), words, F.array(F.lit("<end>"))) if bounds else words
    if n == 1:
        return w
    runs = lambda w: F.transform(F.slice(w, 1, F.size(w) - (n - 1)), lambda x, i: F.concat_ws("_", x, *[F.get(w, i + k) for k in range(1, n)]))
    return let(w, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def skip_bigrams(words: Column, gap: int = 4) -> Column:
    """Distinct ordered pairs with at most `gap` words between them."""
    pairs = lambda w: F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.lit(gap + 1)), lambda y: F.concat_ws("_", x, y)))
    return let(words, lambda w: F.array_distinct(F.flatten(pairs(w))))


def skip_units(words: Column, gap: int = 4) -> Column:
    """Skip bigrams and single words."""
    return let(words, lambda w: F.array_union(skip_bigrams(w, gap), w))


UNITS = {"n1": lambda w: ngrams(w, 1), "n2": lambda w: ngrams(w, 2), "n3": lambda w: ngrams(w, 3), "n4": lambda w: ngrams(w, 4), "su4": skip_units, "n12": lambda w: let(w, lambda w: F.concat(ngrams(w, 1), ngrams(w, 2))), "n23": lambda w: let(w, lambda w: F.concat(ngrams(w, 2), ngrams(w, 3))), "s2": lambda w: skip_bigrams(w, 2)}


def units(words: Column, kind: str) -> Column:
    return UNITS[kind](words)


#: English function words; a parameter wherever it is used, and results depend on it.
STOPWORDS = tuple(
    """a an the this that these those each every some any no none both all either neither such same other another
    i me my mine we us our ours you your yours he him his she her hers it its they them their theirs who whom whose which what
    and or but nor so yet if then else because although though while unless until since whether than as
    of in on at by for with about against between into through during before after above below to from up down out off over under
    am is are was were be been being have has had having do does did doing will would shall should can could may might must
    not only own too very just now here there when where why how again further once more most few""".split()
)


def stopwords() -> tuple[str, ...]:
    return STOPWORDS


def without_stopwords(words: Column, stop: tuple[str, ...]) -> Column:
    """Repeats stay."""
    return F.filter(words, lambda w: ~w.isin(*stop))


def just_stopwords(words: Column, stop: tuple[str, ...]) -> Column:
    """True of an empty list."""
    return F.forall(words, lambda w: w.isin(*stop))


def is_quoted(s: Column) -> Column:
    return s.rlike('^["(].*[")]$')


# fixed values: phrases that the cleaning rules know
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
DAY_PHRASE = f"(^| |, )(on|last|this|next|late) ({WEEKDAYS})( morning| afternoon| evening| night| alone)?($| |,|\\.)"
SAID = ', [^,"]*? (said|reported)\\.$'
OPENING_MARKERS, CONJUNCTIONS, INNER_MARKERS = "^(however|still|so|nonetheless), ", "^(and|but),? ", ", (however|though|meanwhile),"
TOLD = ',[^,."]*? (said|reported|told|announced|according to)[^,]*?\\.$'
NOT_OPENING, NOT_CLOSING = ("as", "if", "since", "asked"), ("and", "but", "although", "or")
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _capital(s: Column) -> Column:
    """The first letter in upper case, or the one after an opening quotation mark; ASCII letters only."""
    at = F.when(F.startswith(s, F.lit('"')), 2).otherwise(1)
    up = F.translate(F.substring(s, at, F.lit(1)), _LOWER, _LOWER.upper())
    return F.concat(F.substring(s, F.lit(1), at - 1), up, F.substring(s, at + 1, F.length(s)))


def clean_sentence(s: Column) -> Column:
    """Of sentences with over 8 words: phrases with a weekday, a closing attribution (if over 10 words are left), and discourse markers taken out."""
    day = F.regexp_replace(s, f"(?i){DAY_PHRASE}", "$5")
    day = F.regexp_replace(F.regexp_replace(day, "^, (\\w)", "$1"), "\\s+", " ")
    x = let(day, lambda x: F.when(n_words(x) > 10, F.regexp_replace(x, f"(?i){SAID}", ".")).otherwise(x))
    for pattern in (f"(?i){OPENING_MARKERS}", f"(?i){CONJUNCTIONS}", INNER_MARKERS):
        x = F.regexp_replace(x, pattern, "")
    return F.when(n_words(s) > 8, let(F.btrim(x, F.lit(BLANKS + "\n")), _capital)).otherwise(s)


def tightened(x: Column) -> Column:
    """A cleaned sentence without its closing clause, if that has an attribution and is shorter than what it follows."""
    words = lambda c: F.filter(F.split(c, "\\s+"), lambda w: w != "")

    def rule(x: Column, end: Column) -> Column:
        before = n_words(F.replace(F.substring(x, F.lit(1), F.length(x) - F.length(end) - 1), F.lit(","), F.lit(" ")))
        kept = lambda clause: F.lower(F.get(words(x), F.lit(0))).isin(*NOT_OPENING) | F.lower(F.get(clause, F.lit(0))).isin(*NOT_CLOSING) | (F.size(clause) >= before) | (F.size(clause) == 0)
        return F.when(F.coalesce(let(words(end), kept), F.lit(True)), x).otherwise(F.regexp_replace(x, f"(?i){TOLD}", "."))

    return let(x, lambda x: let(F.substring_index(x, ",", -1), lambda end: rule(x, end)))


def clean_aggressive(s: Column) -> Column:
    """clean_sentence, and then a closing clause with an attribution goes if it is shorter than what it follows."""
    return tightened(clean_sentence(s))


def clean_html(s: Column) -> Column:
    """Scripts, styles and comments out, tags to spaces, the commonest entities read, white space squeezed."""
    x = F.regexp_replace(s, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(F.regexp_replace(x, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, "[ \\t\\r\\n]+", " "))


def overlap_similarity(a: Column, b: Column) -> Column:
    """|A and B| / max(|A|, |B|) of two sets; null when both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    top = F.greatest(F.size(a), F.size(b))
    return F.when(top > 0, F.size(F.array_intersect(a, b)) / top)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


def word_key(s: Column) -> Column:
    """A spelling key: lower case, z as s, no h, doubled letters once."""
    return F.regexp_replace(F.replace(F.replace(F.lower(s), F.lit("z"), F.lit("s")), F.lit("h"), F.lit("")), "(.)\\1", "$1")


def date_mentions(s: Column) -> Column:
    """Simple time expressions: dates, weekdays, and relative words."""
    return F.regexp_extract_all(F.lower(s), F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2}|(?:mon|tues|wednes|thurs|fri|satur|sun)day|yesterday|today|tomorrow|(?:last|next|this) (?:week|month|year))"), F.lit(1))

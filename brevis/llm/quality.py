"""Quality rules as a ledger of failure bits, on DataFrame functions only.

Every rule is evaluated once per document; the ledger holds one bit per failed
rule beside the measurements. A policy is a bitmask with a version: a document is
kept if it fails none of the policy's rules, so policies can be compared, and
their rules ablated, with bitwise aggregates over the ledger and without a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over the measurements, true where the document fails.
    fails: str
    base: bool = False


#: The order fixes the bits: append, never reorder.
RULES = (
    Rule("too_few_words", "n_words < 10", base=True),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words", base=True),
    Rule("symbol_ratio", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
)
BASE_BITS = sum(1 << i for i, r in enumerate(RULES) if r.base)
#: Version -> bits of the rules that decide.
POLICIES = {1: BASE_BITS, 2: (1 << len(RULES)) - 1}
POLICY = 2


def _measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    # one pass each: words, then a hash of each word; later columns refer to these more than once, so they aren't inlined
    first = docs.select("doc_id", text.alias("text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    second = first.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("\\p{L}")).cast("long").alias("n_letters"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = F.when(F.size("h") >= WINDOW, F.transform(F.slice("h", 1, F.size("h") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])))
    third = second.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_letters",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(window, F.array().cast("array<bigint>")).alias("g"),
    )
    # most texts repeat no window: only the others are sorted
    ranked = third.withColumn("s", F.when(F.size("g") > F.size(F.array_distinct("g")), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("s", lambda a, k: (a["x"] == F.get("s", k - 1)["x"]) | (a["x"] == F.get("s", k + 1)["x"]))
    placed = ranked.withColumn("p", F.array_sort(F.transform(twice, lambda a: a["i"])))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines", "n_letters")


def ledger(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): the measurements and fail_bits long, bit i for RULES[i].

    A null text has no words: all measures are 0 and it fails for having too few.
    Repeated rows and null ids come out as they came in; other columns are ignored;
    an empty table gives an empty one. There is no shuffle: a row is measured where
    it is read, in time that grows with its length times its logarithm at most.
    """
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))
    return _measures(docs.select("doc_id", "text")).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, version: int = POLICY) -> DataFrame:
    """entries (a ledger) with base_failed, kept and policy; the base rules hold under every policy.

    A row's own bits decide, so rows of null texts, repeated rows and empty tables need
    no rule of their own. Other columns stay; columns of the three names are replaced.
    """
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE_BITS)) != 0
    kept = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version] | BASE_BITS)) == 0
    return entries.withColumn("base_failed", failed).withColumn("kept", kept).withColumn("policy", F.lit(version))


def ablation(entries: DataFrame, version: int = POLICY) -> DataFrame:
    """Per rule of a policy: rule, n_fail, n_sole (failing this rule only, so kept without it), and the bits that fail anywhere in any_bits.

    One aggregation over all rows, a few sums a task. Repeated rows count as often as
    they occur; an empty table gives every rule with zeros; other columns are ignored.
    """
    mask = POLICIES[version] | BASE_BITS
    held = F.col("fail_bits").bitwiseAND(F.lit(mask))
    sums = [F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.sum(F.getbit(held, F.lit(i))), F.lit(0)).cast("long").alias("n_fail"), F.count_if(held == F.lit(1 << i)).alias("n_sole"), F.coalesce(F.bit_or(held), F.lit(0)).alias("any_bits")) for i, r in enumerate(RULES) if mask >> i & 1]
    return entries.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")

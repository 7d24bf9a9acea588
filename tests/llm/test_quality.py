"""Quality ledger against brute force, policies and ablation."""

import random
import re
from collections import Counter

from brevis.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, cov = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            cov.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)


def test_measures_match_brute_force(spark):
    rnd = random.Random(6)
    parts = ["a", "b", "é漢", "#", "$x", " ", "  ", "\n", "\n\n", "\t", "\x0b", "w w w w w w", "one two three four five six", "😀", " "]
    rows = [None, "", " \n\t", "x" * 30_000, "a b c d e " * 2000, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(800))]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(rows)], "doc_id long, text string, kept boolean")
    got = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(docs)).collect()}
    for i, t in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), repr(t)[:200]
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good), (2, good + " #" * 30), (3, "too short"), (4, good + " $" * 40), (None, good), (1, good)]
    entries = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = lambda v: sorted(str(r["doc_id"]) for r in quality.apply_policy(entries, v).filter("kept").collect())
    assert kept(2) == ["1", "1", "None"] and "3" not in kept(1)
    a = {r["rule"]: (r["n_fail"], r["n_sole"]) for r in quality.ablation(entries).collect()}
    assert a["too_few_words"] == (1, 1) and a["symbol_ratio"][0] == 2
    assert quality.ledger(entries.select("doc_id").limit(0).selectExpr("doc_id", "'' as text")).count() == 0


def test_native(spark):
    plan = quality.ledger(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

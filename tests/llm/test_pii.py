"""Personal data against a brute-force version with Python's own regexes."""

import hashlib
import random
import re

from brevis.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(x)) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def texts():
    rnd = random.Random(3)
    parts = ["a@b.co", "@", ".", "..", "x.y", "1", "12", "255", "256", "0300", "+", "+1", "(269)", " ", "-", "4532015112830366", "4532 0151 1283 0366", "é", "漢", "\n", "@mail", "%", "_", "1.2.3.4", "5.6", "555-3296", "\t", "😀"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16))) for _ in range(3000)]
    return [None, "", "a" * 60_000, "1" * 60_000, "9.9.9.9 " * 300, "x@y.z," * 300, "+" * 500, *made]


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        r = got[i]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r[f"n_{k}"] for k in RULES] == [sum(x[0] == k for x in want) for k in RULES], (t, want, r)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (t, want, r)
        assert [s for s in r["spans"].split(",") if s and not s.startswith("like_")] == [s for s in joined.split(",") if s]


def test_context_finds_unseen_identifiers_and_redaction_removes_them(spark):
    seeds = [(i, f"please write to customer mailbox user{i}@host.example.com without delay {i} thanks") for i in range(12)]
    rows = [*seeds, (50, "please write to customer mailbox jim@intranet without delay"), (51, "nothing to see at 1234 here")]
    docs = spark.createDataFrame([(i, t, len(t), "x") for i, t in rows], "doc_id long, text string, n_chars long, more string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    text = rows[12][1]
    a = text.index("jim@")
    assert got[50] == f"like_email:{a}:{a + 12}" and got[51] == ""
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).schema == docs.schema
    assert out[50]["text"] == "please write to customer mailbox <LIKE_EMAIL> without delay" and out[50]["n_chars"] == len(out[50]["text"])
    assert out[0]["text"] == "please write to customer mailbox <EMAIL> without delay 0 thanks" and out[51]["text"] == rows[13][1] and out[51]["more"] == "x"


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string, n_chars long"
    assert pii.find_personal_data(spark.createDataFrame([], schema)).count() == 0
    assert pii.redact(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, None, None), (1, "a@b.co", 6), (1, "a@b.co", 6), (None, "+1 (269) 555-3296 a@b.co", None)], schema)
    assert sorted(r["text"] or "" for r in pii.redact(docs).collect()) == ["", "<EMAIL>", "<EMAIL>", "<PHONE> <EMAIL>"]
    assert pii.find_personal_data(docs).count() == 4

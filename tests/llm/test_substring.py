"""Substring dedup finds every long shared passage, wherever lines and sentences end."""

import random

from brevis.llm import substring


def test_any_shared_run_of_fifty_words_holds_a_whole_unit():
    rnd = random.Random(7)
    for trial in range(300):
        word = lambda k: f"w{rnd.randrange(5000)}" + rnd.choice(["", "", "", ".", ".\n"] if trial % 3 else [""])  # noqa: B023, E731
        shared = " ".join(word(k) for k in range(50))
        a, b = (" ".join([*map(word, range(rnd.randrange(60))), shared, *map(word, range(rnd.randrange(60)))]) for _ in range(2))
        left = {d for s, e, d in substring.units(a) if a.index(shared) <= s and e <= a.index(shared) + len(shared)}
        right = {d for s, e, d in substring.units(b) if b.index(shared) <= s and e <= b.index(shared) + len(shared)}
        assert left & right


def test_a_text_of_one_word_keeps_its_first_units(spark):
    docs = spark.createDataFrame([(1, "ho " * 400)], "doc_id long, text string")
    (left,) = substring.remove_repeated(docs).collect()
    assert substring.GRAM <= len(left["text"].split()) < 200
    assert len(substring.units("ho " * 4000)) < 4000 / substring.WINDOW * 1.2


def brute(rows, unit):
    """Occurrences in order of (id, null last; start; row); all but the first of a digest, unless they overlap it."""
    found = []
    for row, (i, t) in enumerate(rows):
        found += [((i is None, i or 0, a, row), a, z, d) for a, z, d in (substring.units(t, unit) if t else [])]
    first, out = {}, []
    for place, a, z, d in sorted(found):
        if d not in first:
            first[d] = (place, z)
        elif not (place[3] == first[d][0][3] and a < first[d][1]):
            out.append((place[3], a, z, d.hex()))
    return sorted(out)


def test_units_match_brute_force_over_short_lines(spark):
    rnd = random.Random(4)
    lines = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))) for _ in range(20)] + ["", "  ", "-"]
    rows = [(rnd.choice([None, *range(12)]), rnd.choice([None, "", "\n".join(rnd.choices(lines, k=rnd.randrange(1, 9)))])) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, row int").coalesce(1)
    for unit in substring.UNITS:
        got = substring._later(docs.selectExpr("doc_id", "monotonically_increasing_id() as row", "text"), unit).collect()
        at = sorted({r["row"] for r in docs.selectExpr("monotonically_increasing_id() as row").collect()})
        assert sorted((at.index(r["row"]), r["start"], r["end"], r["digest"]) for r in got) == brute(rows, unit)
        assert substring.repeated_units(docs, unit).count() == len(got)


def test_rows_of_one_id_or_none_keep_one_copy_and_their_own_text(spark):
    a, b = "Alpha beta.\nGamma", "Delta epsilon\n\nAlpha beta.\nGamma"
    rows = [(1, a), (1, a), (None, b), (None, "zeta eta theta"), (2, None), (3, ""), (None, "iota\n\nDelta epsilon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in substring.remove_repeated(docs).collect())
    assert got == sorted([(1, a), (1, ""), (0, "Delta epsilon\n\n"), (0, "zeta eta theta"), (2, ""), (3, ""), (0, "iota\n\n")])


def test_a_very_long_text_and_an_empty_table(spark):
    rnd = random.Random(5)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "x " + text + " y")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeated(docs).collect()}
    assert left[1] == text and len(left[2]) < 0.6 * len(text)
    assert substring.remove_repeated(docs.limit(0)).count() == 0


def test_a_hot_unit_is_split(spark):
    rows = [(i, "same words here" if i % 3 == 0 else f"own words {i}") for i in range(3000)]
    got = substring.repeated_units(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["first_doc_id"], r["end"]) for r in got.collect()} == {(0, 15)} and got.count() == 999

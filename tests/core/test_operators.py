"""Worked cases and properties of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.stem import stem
from brevis.operators import concepts as C
from brevis.operators import learning as L
from brevis.operators import rouge as R
from brevis.operators import selection as S
from brevis.operators import statistics as ST
from brevis.operators import trees as N
from brevis.sources import corpora


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_ngrams_and_skip_bigrams(spark):
    w = F.col("w")
    assert one(spark, T.ngrams(w, 2), w=["a", "b", "c"]) == ["a_b", "b_c"]
    assert one(spark, T.ngrams(w, 4), w=["a", "b", "c"]) == []
    assert one(spark, T.ngrams(w, 2, True), w=["a", "b", "c"]) == ["<start>_a", "a_b", "b_c", "c_<end>"]
    pairs = one(spark, T.skip_bigrams(w, 2), w=list("abcde"))
    assert len(pairs) == 9 and "a_e" not in pairs
    assert one(spark, T.skip_bigrams(w, 4), w=["a"]) == []


def test_word_tokens_split_hyphens(spark):
    assert one(spark, T.word_tokens(F.col("s")), s="-b a--b c- -d") == ["-", "b", "a", "--", "b", "c-", "-", "d"]


def test_clean_sentence(spark):
    s = "However, officials in the capital said on Monday that talks would continue, a spokesman said."
    assert one(spark, T.clean_sentence(F.col("s")), s=s) == "Officials in the capital said that talks would continue."


def test_similarity(spark):
    sim = T.overlap_similarity(F.col("a"), F.col("b"))
    assert one(spark, sim, a=["peace", "talk", "india"], b=["peace", "talk"]) == pytest.approx(2 / 3)
    assert one(spark, sim, a=[], b=[]) is None


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "digitizer": "digit", "vietnamization": "vietnam", "hopefulness": "hope", "formalize": "formal", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "rate": "rate", "is": "is"}
    assert {w: stem(w) for w in pairs} == pairs


SENTS = [("t-A", "d1", 0, "Peace talks resumed between India and Pakistan on Monday morning"), ("t-A", "d1", 1, "The peace talks will continue."), ("t-A", "d2", 0, "Leaders praised the peace talks held in the capital city yesterday")]
STOP = ("the", "between", "and", "on", "will", "in")


def weighed(spark):
    s = spark.createDataFrame(SENTS, "topic_id string, doc_id string, ord int, orig string")
    s = s.select("*", T.tokenize(F.col("orig")).alias("words"), T.n_words(F.col("orig")).alias("length"))
    return C.with_overlap(s, spark.createDataFrame([("t-A", "peace talks")], "topic_id string, query string"), STOP)


def test_production_weights(spark):
    s = weighed(spark)
    for docset, want in (("A", {"peace_talks": 5, "the_peace": 3}), ("B", {"peace_talks": 7, "the_peace": 4})):
        assert {r["concept"]: r["weight"] for r in C.production_weights(s, C.RULES[docset], STOP).collect()} == want
    assert {(r["doc_id"], r["ord"]) for r in C.candidates(s).collect()} == {("d1", 0), ("d2", 0)}


def test_selection_worked_case():
    p = S.Problem([10, 11], [frozenset({"pt"}), frozenset({"pt", "tp"})], {"pt": 5.0, "tp": 3.0}, 100)
    assert S.exact(p)[0] == [1] and S.exact(p)[1] == pytest.approx(7.989)
    assert [(c, round(v, 3)) for c, v, _ in S.n_best(p, 2)] == [([1], 7.989), ([0], 4.99)]
    p.budget = 10
    assert S.exact(p)[0] == [0]
    p.budget = 9
    assert S.exact(p)[0] == []
    p.budget, p.group = 100, ["g", "g"]
    assert S.exact(p)[0] == [1]


def test_exact_selection_is_optimal():
    rnd = random.Random(5)
    for trial in range(40):
        n = rnd.randint(1, 10)
        sents = [frozenset(rnd.sample("abcdefgh", rnd.randint(1, 4))) for _ in range(n)]
        p = S.Problem([rnd.randint(3, 30) for _ in range(n)], sents, {c: float(rnd.randint(1, 9)) for c in "abcdefgh"}, rnd.randint(5, 80))
        if trial % 3 == 1:
            p.group = [rnd.choice("xyz") for _ in range(n)]
        if trial % 3 == 2:
            p.needs = [rnd.sample(range(n), rnd.randint(0, 1)) for _ in range(n)]
        best = max(p.value(s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if p.allowed(s))
        chosen, value, status = S.exact(p)
        assert status == "optimal" and p.allowed(chosen) and value == pytest.approx(best) and p.value(chosen) == pytest.approx(best)
        for other in (S.greedy(p), S.swap_search(p, 20)):
            assert p.allowed(other) and p.value(other) <= best + 1e-9


def test_reading_order(spark):
    rows = [("t", 0, 1, 2, 12), ("t", 0, 2, 0, 15), ("t", 0, 2, 1, 10), ("t", 0, 3, 0, 20)]
    schema = "topic_id string, rank int, doc_id long, ord int, length int"
    order = lambda r: [x["length"] for x in S.promote_first(spark.createDataFrame(r, schema)).orderBy("pos").collect()]
    assert order(rows) == [20, 12, 15, 10]
    assert order([("t", 0, 1, 0, 12), *rows[1:]]) == [12, 15, 10, 20]


def test_rouge(spark):
    def score(peer, model, metric):
        p = spark.createDataFrame([("t", "p", peer)], "topic_id string, peer_id string, text string")
        m = spark.createDataFrame([("t", "m", model)], "topic_id string, annotator string, text string")
        return R.rouge(p, m, metric).first()["recall"]

    assert score("police killed the gunman", "police kill the gunman", "R1") == pytest.approx(0.75)
    assert score("police killed the gunman", "police kill the gunman", "R2") == pytest.approx(1 / 3)
    assert score("police killed the gunman", "police kill the gunman", "SU4") == pytest.approx(5 / 9)
    assert score("a b b", "a a b", "R1") == pytest.approx(2 / 3)
    assert score("a b c", "a b c", "SU4") == 1


def test_smoothing_and_divergence(spark):
    c = spark.createDataFrame([("k", "a", 3), ("k", "b", 1)], "by string, s string, c long")
    get = lambda m, **kw: {r["s"]: r["p"] for r in ST.smoothed(c, ("by",), m, **kw).collect()}
    assert get("ele", bins=3)["a"] == pytest.approx(0.636364, abs=1e-6) and get("laplace", bins=3)["b"] == pytest.approx(2 / 7)
    assert get("witten_bell") == {"a": 0.5, "b": pytest.approx(1 / 6)} and get("mle") == {"a": 0.75, "b": 0.25}
    h = spark.createDataFrame([("k", "a", 2), ("k", "b", 1), ("k", "c", 1)], "by string, s string, c long")
    e = ST.entropy(h, ("by",)).first()
    assert e["entropy"] == pytest.approx(1.5) and e["signed_entropy"] == pytest.approx(-1.5)
    p = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 0.5)], "by string, s string, p double")
    q = spark.createDataFrame([("k", "a", 0.25), ("k", "b", 0.75)], "by string, s string, p double")
    assert ST.kl_divergence(p, q, "by", "s").first()["kl"] == pytest.approx(0.207519, abs=1e-6)
    assert one(spark, ST.window_diff(F.col("a"), F.col("b"), 1), a="0100", b="0010") == 2


def test_stumps_and_boosting(spark):
    rows = spark.createDataFrame([("x", "1")] * 3 + [("y", "0")] * 3 + [("y", "1")], "v string, label string")
    counts = L.value_counts(rows, ["v"], "label")
    assert L.one_rule(counts).first()["error"] == pytest.approx(1 / 7)
    stump = spark.createDataFrame([("np", 1.0, 0.2976, -3.983)], "token string, alpha double, c0 double, c1 double")
    f = spark.createDataFrame([(1, "np"), (2, "other")], "k long, token string")
    got = {r["k"]: r["posterior"] for r in L.boosting_scores(f, stump, "k").collect()}
    assert got[1] == pytest.approx(1 - 0.99965, abs=1e-5) and got[2] == pytest.approx(1 - 0.35545, abs=1e-4)


def test_trees():
    nodes = N.parse_brackets("(S (NP a b) (VP c))")
    assert [(n[3], n[4], n[5], n[6]) for n in nodes] == [("S", None, 0, 3), ("NP", "a b", 0, 2), ("VP", "c", 2, 3)]
    assert N.parse_brackets(None) == [] and N.parse_brackets("") == []


def test_readers(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<x><topic id="D1"><title> A </title><narrative>N</narrative><docsetA id="D1-A"><doc id="d1"/><doc id="d2"/></docsetA><docsetB id="D1-B"><doc id="d3"/></docsetB></topic></x>')
    t = corpora.topics_xml(corpora.whole_files(spark, str(tmp_path), "*.xml"))
    assert {(r["docset"], r["doc_id"], r["doc_pos"]) for r in t.collect()} == {("D1-A", "d1", 0), ("D1-A", "d2", 1), ("D1-B", "d3", 0)}
    assert {(r["docset"], r["old_doc"]) for r in corpora.earlier_documents(t).collect()} == {("D1-B", "d1"), ("D1-B", "d2")}
    (tmp_path / "n.sgm").write_text("<DOC><DOCNO> XIN_ENG_20041113.0001 </DOCNO><TEXT><P>LONDON (AP) -- It rained .Today</P><P>More , text</P></TEXT></DOC>")
    n = corpora.newswire(corpora.whole_files(spark, str(tmp_path), "*.sgm")).first()
    assert (n["doc_id"], n["source"], n["date_key"]) == ("XIN_ENG_20041113.0001", "XIN", "_ENG_20041113.0001")
    assert n["paragraphs"] == ["It rained .Today", "More, text"]
    (tmp_path / "c.conll").write_text("1\tA\t2\n2\tb\t0\n\n1\tC\t0\n")
    c = corpora.conll(corpora.whole_files(spark, str(tmp_path), "*.conll"), ("id", "form", "head"))
    assert [(r["sentence"], r["tok_id"], r["form"]) for r in c.orderBy("sentence", "tok_id").collect()] == [(0, 1, "A"), (0, 2, "b"), (1, 1, "C")]


def test_row_rules():
    from brevis.functions import rows
    from brevis.operators import ordering

    assert rows.glue_quotes(['He said "yes.', 'And no."', "Then left."]) == ['He said "yes. And no."', "Then left."]
    assert rows.glue_quotes(['An "open one.', "Next."]) == ['An "open one.', "Next."]
    assert rows.keep_sentences(["By Jane Doe.", "It rained all day.", "By Monday it stopped.", "ALL CAPS HERE.", "no end", "Call 555-1234 now."]) == ["It rained all day.", "By Monday it stopped."]
    toks = rows.treebank_tokens('They\'ll say "hello, world" (twice).')
    assert toks == ["They", "'ll", "say", "``", "hello", ",", "world", "''", "(", "twice", ")", "."]
    assert rows.detokenize(toks) == 'They\'ll say "hello, world" (twice).'
    assert rows.string_similarity("abc", "abc") == 1.0 and rows.string_similarity("ab", "cd") == 0
    codes = rows.huffman_codes({"a": 5, "b": 2, "c": 1})
    assert len(codes["a"]) == 1 and len(codes["b"]) == len(codes["c"]) == 2
    assert [rows.syllables(w) for w in ("make", "table", "banana", "")] == [1, 2, 3, 0]
    assert sorted(ordering.dendrogram_order([{"a"}, {"b"}, {"a", "b"}], {("a", "b"): 2.0}, {"a"})) == [0, 1, 2]

"""Language ID, mixing and piece sampling."""

import random
import zlib

import numpy as np
import pytest

from brevis.llm import features, langid, mixing, pieces

VOICES = {"xx": "kala mato sine bulo vek", "yy": "thron gward schlit pfumm durch", "zz": "oui eau lait beaux ieux"}


def speech(lang, seed, n=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(VOICES[lang].split()) for _ in range(rnd.randint(1, 2))) for _ in range(n)) + "."


def language_docs(spark):
    rows = [(i, speech(k, i), k, "s") for i, k in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(500, None, "xx", "s"), (501, "", "yy", "s"), (502, "1234 !?", None, "s"), (503, "Ωμέγαάλφα βήταγάμμα δέλταέψιλον " * 20, None, "s"), (None, speech("xx", 9), "xx", None), (3, rows[3][1], rows[3][2], "s"), (504, speech("yy", 77), None, "s")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_id_holds_out_and_rejects(spark):
    rows, docs = language_docs(spark)
    got = langid.predict_languages(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text, lang, _ in rows:
        if i is not None:
            assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
            assert 0 <= by[i]["score"] <= 1
            if lang and text:
                assert by[i]["lang_pred"] == lang
    assert all(by[i]["lang_pred"] == "und" and by[i]["rejected"] for i in (500, 501, 502))
    assert by[503]["rejected"] and by[504]["lang_pred"] == "yy" and not by[504]["rejected"]
    kept = langid.drop_rejected(docs)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 4
    assert langid.predict_languages(docs.limit(0)).count() == 0
    unlabelled = langid.predict_languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_gram_counts_are_linear_in_length():
    x = features.letter_counts("abc abc")
    assert x.sum() == 9 + 8 + 7 and features.byte_counts(b"").sum() == 0


def test_rates_meet_their_targets(spark):
    rows = [(i, speech("xx" if i % 3 else "yy", i, 20 + i % 30), "s") for i in range(90)] + [(None, None, None), (200, "", "s"), (1, speech("xx", 1, 21), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, "common" if i % 3 else "scarce") for i in range(0, 90, 2)] + [(None, "common"), (4, None), (6, "zzz"), (6, "scarce")], "doc_id long, domain string")
    even = lambda t: np.full(len(t), t.sum() / len(t))
    out = mixing.document_rates(docs, labels, even).collect()
    assert len(out) == len(rows) and all(r["rate"] >= 0 for r in out)
    total = sum(r["n_tokens"] for r in out)
    for d in ("common", "scarce"):
        assert sum(r["rate"] * r["n_tokens"] * r["posterior"][d] for r in out) == pytest.approx(total / 2, rel=1e-6)
    mixed = mixing.mix(docs, labels, even)
    assert mixed.schema == docs.schema and mixed.count() > 60
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs, labels, even).collect()))
    assert {r["rate"] for r in mixing.document_rates(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.document_rates(docs.limit(0), labels).count() == 0


def test_clipped_rates_stay_nonnegative(spark):
    soft = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.5, 0.5]), (30, [0.1, 0.9])], "n_tokens long, posterior array<double>")
    steps, wanted, reached = mixing.fit_rates(soft, 2, lambda t: np.array([30.0, 4.0]))
    assert len(steps) > 1 and reached == pytest.approx(wanted, rel=0.05)
    assert min(r[0] for r in soft.select(mixing.rate(steps)).collect()) >= 0


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.model_path())


def test_round_trip_and_batches(vocab):
    rnd = random.Random(8)
    texts = ["", " ", "a", "  two  spaces ", "tab\there\n\n\r\x00", "▁ literal", "é ñ 漢字 😀", "x" * 4000, " ".join("the nation of word".split() * 50), "漢" * 100, *("".join(rnd.choice("ab é\n▁漢 .") for _ in range(40)) for _ in range(200))]
    data = [t.encode() for t in texts] + [b"\xff\xfe broken \x80"]
    seeds = list(map(pieces.seed_of, range(len(data))))
    got = pieces.encode(data, seeds, vocab)
    for d, ids in zip(data, got, strict=True):
        assert vocab.decode(ids.tolist()) == d
    for k in (3, 8, 20):
        assert (pieces.encode([data[k]], [seeds[k]], vocab)[0] == got[k]).all()


def test_samples_follow_the_lattice(vocab):
    def segmentations(s):
        if not s:
            yield (), 1.0
        for e in range(1, len(s) + 1):
            i = vocab.ids.get(s[:e])
            if i is not None:
                for rest, p in segmentations(s[e:]):
                    yield (i, *rest), p * vocab.weight[i]

    for word in ("nation", "thing"):
        want = dict(segmentations(f" {word}"))
        total, n = sum(want.values()), 6000
        got: dict = {}
        for ids in pieces.encode([word.encode()] * n, [pieces.seed_of(k) for k in range(n)], vocab):
            got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
        assert set(got) <= set(want)
        for s, p in want.items():
            assert got.get(s, 0) / n == pytest.approx(p / total, abs=0.03)


def test_documents_round_trip(spark):
    rows = [(1, "plain text"), (None, None), (2, ""), (1, "plain text"), (3, "é\n x")]
    out = pieces.encode_documents(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int"))
    got = out.collect()
    assert len(got) == 5 and all(r["lossless"] in (True, None) for r in got)
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 1
    back = sorted((str(r["doc_id"]), str(r["text"])) for r in pieces.decode_documents(out).collect())
    assert back == sorted((str(i), str(t)) for i, t in rows)
    assert pieces.encode_documents(out.selectExpr("doc_id", "'' as text").limit(0)).count() == 0


def test_predictions_match_cosines_computed_apart(spark):
    """IDF by counting documents, cosines by dictionaries, from the fitted centroids; each fitted centroid is a mean of its nearest sample texts."""
    rows, docs = language_docs(spark)
    model = langid.fit(langid._training(docs), docs["doc_id"])
    train = [t for i, t, lang, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 and lang and t]
    df = sum((features.letter_counts(t) > 0).astype(int) for t in train)
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    assert np.abs(model.idf - idf).max() < 1e-5

    def tfidf(t):
        c = features.letter_counts(t)
        v = {int(k): (1 + np.log(c[k])) * idf[k] for k in np.flatnonzero(c)}
        n = sum(x * x for x in v.values()) ** 0.5
        return {k: x / n for k, x in v.items()}

    sample = {lang: [tfidf(t) for i, t, k, _ in rows if k == lang and t and i is not None and zlib.crc32(str(i).encode()) % 5] for lang in model.langs}
    for j, centre in enumerate(model.centroids.T):
        lang = model.owner[j]
        own = [v for v in sample[model.langs[lang]] if max(range(len(model.owner)), key=lambda c: (model.owner[c] == lang) * sum(x * model.centroids[k, c] for k, x in v.items())) == j]
        mean = np.zeros(features.DIMS)
        for v in own:
            for k, x in v.items():
                mean[k] += x
        if own:
            assert np.abs(centre - mean / np.linalg.norm(mean)).max() < 0.05
    got = {r["doc_id"]: r for r in langid.predict_languages(docs).collect()}
    for i, t, _, _ in rows:
        if i is not None and t and any(map(str.isalpha, t)):
            v = tfidf(t)
            cosines = [sum(x * float(model.centroids[k, j]) for k, x in v.items()) for j in range(len(model.owner))]
            best = int(np.argmax(cosines))
            assert got[i]["score"] == pytest.approx(min(1, max(0, cosines[best])), abs=1e-5)
            assert max(c for c, o in zip(cosines, model.owner, strict=True) if model.langs[o] == got[i]["lang_pred"]) == pytest.approx(cosines[best], abs=1e-6)


def test_rates_match_least_squares_computed_apart(spark):
    """Nonnegative rates nearest to one that meet the targets, by a projected gradient over all rows at once with numpy."""
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 40), [p, 1 - p]) for p in (rnd.random() ** 3 for _ in range(200))]
    soft = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    want = lambda t: np.array([0.2, 0.8]) * t.sum()
    steps, wanted, reached = mixing.fit_rates(soft, 2, want)
    n, q = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    dual = np.zeros(2)
    goal = want((q * n[:, None]).sum(0))
    for _ in range(200_000):  # rates max(0, 1 + q . dual): the dual of the same least squares
        miss = goal - (np.maximum(0, 1 + q @ dual) * n) @ q
        dual += 1e-4 * miss
        if np.abs(miss).max() < 1e-9 * goal.max():
            break
    assert wanted == pytest.approx(goal) and reached == pytest.approx(goal, rel=1e-6)
    got = np.array([r["r"] for r in soft.select(mixing.rate(steps).alias("r")).collect()])
    assert (got >= 0).all() and (got * n) @ q == pytest.approx(goal, rel=1e-6)
    best, own = (n * (np.maximum(0, 1 + q @ dual) - 1) ** 2).sum(), (n * (got - 1) ** 2).sum()
    assert own <= 1.05 * best + 1e-6


def test_targets_out_of_reach_are_reported(spark):
    soft = spark.createDataFrame([(10, [1.0, 0.0])] * 3, "n_tokens long, posterior array<double>")
    steps, wanted, reached = mixing.fit_rates(soft, 2, lambda t: np.array([10.0, 20.0]))
    assert len(steps) <= 3 and mixing.residual(wanted, reached) >= 0.9


def test_long_words_follow_the_same_lattice_and_stay_lossless():
    vocab = pieces.vocabulary(pieces.model_path())
    n, word = 6000, " antidisestablish"
    short = pieces.encode([word[1:].encode()] * n, list(range(n)), vocab)
    long = pieces.LongWord(vocab, word)
    count = lambda many: {k: sum(tuple(x) == k for x in many) / n for k in {tuple(x) for x in many}}
    a, b = count([x.tolist() for x in short]), count([long.sample(np.uint64(pieces.seed_of(i))).tolist() for i in range(n)])
    assert max(abs(a.get(k, 0) - b.get(k, 0)) for k in {*a, *b}) < 0.04
    text = ("x" * 70_000 + "é" * 10 + "▁" + "ab" * 40_000).encode() + b"\xff" + b" end"
    (ids,) = pieces.encode([text], [7], vocab)
    assert vocab.decode(ids.tolist()) == text

"""Language-model scoring: exact base counts, a proper distribution, and a better held-out score than the base."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from brevis.llm import lm


def documents(spark):
    docs = [(i, " ".join(f"w{(i * k) % 23} of The" for k in range(1, 9))) for i in range(120)]
    return docs + [(200, None), (201, ""), (None, "of the"), (5, docs[5][1]), (202, "unseen words here"), (203, "\x0b \t\n")]


def test_base_scores_match_brute_force(spark, monkeypatch):
    rows = documents(spark)
    tok = lambda t: lm.tokens((t or "").encode())
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tok(t))
    n, v = sum(c.values()), len(c)
    for known, frequent in ((1 << 18, 1024), (10, 4)):  # the second sends most words through the join
        monkeypatch.setattr(lm, "KNOWN", known)
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = lm.score_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, c string")).collect()
        assert len(got) == len(rows)
        want = sorted((i if i is not None else -1, len(tok(t)), sum(c[w] > 0 for w in tok(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {n}
        held = [r for r in got if r["held_out"]]
        assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_averaged_model_is_a_distribution():
    rng = np.random.default_rng(1)
    c = rng.poisson(0.4, (6, 6)).astype(float)
    c[2] = 0
    p = lm.sample_pairs(c)
    assert p.sum(1) == pytest.approx(np.ones(6)) and (p > 0).all()
    counts, words = np.array([1.0, 2.0, 7.0]), np.array([50, 10, 3])
    r = lm.sample_rare(counts, words)
    assert (r[:-1] * words).sum() + r[-1] == pytest.approx(1, abs=0.02)
    assert lm.sample_pairs(c, seed=3).shape == c.shape and (lm.sample_pairs(c, seed=3) == lm.sample_pairs(c, seed=3)).all()


def test_seating_keeps_its_bounds():
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 2, 50, 5000, 300000])
    t = lm.seat(rng, n, np.full(6, 0.1), n / 3)
    assert (t <= n).all() and (t[1:] >= 1).all() and t[0] == 0


def exact(c, base, tables):
    """Odds of 1..c tables, from the recursion that defines the Stirling numbers."""
    s = {1: 1.0}
    for i in range(1, c):
        s = {k: s.get(k - 1, 0.0) + (i - lm.DISCOUNT * k) * s.get(k, 0.0) for k in range(1, i + 2)}
    p = np.array([s[k] * math.prod((lm.STRENGTH + lm.DISCOUNT * (tables + j)) * base for j in range(k)) for k in range(1, c + 1)])
    return p / p.sum()


@pytest.mark.parametrize(("c", "base", "tables"), [(1, 0.3, 4), (2, 0.01, 50), (5, 0.01, 50), (20, 0.01, 50), (20, 0.3, 3), (60, 0.9, 0), (80, 0.5, 400)])
def test_seating_matches_the_exact_posterior(c, base, tables):
    n, p = 100_000, exact(c, base, tables)
    t = lm.seat(np.random.default_rng(3), np.full(n, c), np.full(n, base), np.full(n, tables))
    share = np.bincount(t, minlength=c + 1)[1:] / n
    assert np.abs(share - p).max() < 5 * 0.5 / n**0.5
    alike = lm._seat_alike(np.random.default_rng(4), c, n, base, tables) / n
    assert alike == pytest.approx((p * np.arange(1, c + 1)).sum(), abs=0.05)


def test_gibbs_sweeps_match_the_exact_posterior_of_a_small_restaurant():
    # one restaurant over a fixed base, two dishes: the joint posterior by enumeration
    c, base = np.array([4, 3]), np.array([0.2, 0.5])
    rng, t, seen = np.random.default_rng(5), np.array([1, 1]), np.zeros((4, 3))
    for _ in range(20_000):
        for w in (0, 1):
            t[w] = lm.seat(rng, c[w : w + 1], base[w : w + 1], t[1 - w : 2 - w])[0]
        seen[t[0] - 1, t[1] - 1] += 1
    want = np.zeros((4, 3))
    for b in range(1, 4):
        other = exact(3, base[1], 0)[b - 1]
        want[:, b - 1] = other * _unnormalised(4, base[0], b)
    assert np.abs(seen / seen.sum() - want / want.sum()).max() < 0.02


def _unnormalised(c, base, tables):
    s = {1: 1.0}
    for i in range(1, c):
        s = {k: s.get(k - 1, 0.0) + (i - lm.DISCOUNT * k) * s.get(k, 0.0) for k in range(1, i + 2)}
    return np.array([s[k] * math.prod((lm.STRENGTH + lm.DISCOUNT * (tables + j)) * base for j in range(k)) for k in range(1, c + 1)])


def test_top_words_are_found_by_a_threshold(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3)
    docs = spark.createDataFrame([(i, "a a a b b c c d") for i in range(20)], "doc_id long, text string")
    model, _ = lm.fit(docs)
    assert set(model.counts) == {b"a", b"b", b"c", lm.END}


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def full_model(rows, sweeps=400, kept=300):
    """log10 P of every text by the sampler in memory over all pairs of words."""
    tok = lambda t: lm.tokens((t or "").encode())
    train = [tok(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    place = {w: k for k, w in enumerate(sorted({lm.END} | {w for t in train for w in t}))}  # the end is first, the unseen word last
    c = np.zeros((len(place) + 1, len(place) + 1))
    for t in train:
        for u, w in zip([lm.END, *t], t, strict=False):
            c[place[u], place[w]] += 1
    p = np.log10(lm.sample_pairs(c, sweeps, kept))
    at = lambda w: place.get(w, len(place))
    return [sum(p[at(u), at(w)] for u, w in zip([lm.END, *tok(t)], tok(t), strict=False)) for _, t in rows]


@pytest.mark.parametrize(("known", "frequent", "bucket"), [(1 << 18, 1024, 1 << 19), (12, 4, 100)])
def test_every_pair_of_words_has_its_own_cell(spark, monkeypatch, known, frequent, bucket):
    # whatever lies in arrays or buckets, scores are those of the model over all pairs
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{a} x{a} y{b}" if a % 2 else f"w{a} z{a}" for a, b in zip(rng.zipf(1.3, 9) % 40, rng.integers(0, 60, 9), strict=True))) for i in range(300)]
    rows += [(1000, "never met"), (1001, None), (1002, "w1 never x1")]
    for name, value in (("KNOWN", known), ("FREQUENT", frequent), ("BUCKET", bucket), ("SWEEPS", 8), ("KEPT", 5)):
        monkeypatch.setattr(lm, name, value)
    got = dict(lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "score").collect())
    own, want = np.array([got[i] for i, _ in rows]), np.array(full_model(rows))
    assert np.abs(own - want).max() < 0.03 * np.abs(want).max() and abs(own.sum() - want.sum()) < 0.01 * abs(want.sum())


@pytest.mark.parametrize(("c", "odds"), [(2, 0.1), (5, 0.7), (8, 3.0), (9, 0.2), (40, 5.0), (80, 60.0)])
def test_seating_at_a_rate_matches_the_exact_posterior(c, odds):
    n, s = 100_000, {1: 1.0}
    for i in range(1, c):
        s = {k: s.get(k - 1, 0.0) + (i - lm.DISCOUNT * k) * s.get(k, 0.0) for k in range(1, i + 2)}
    p = np.array([s[k] * (lm.DISCOUNT * odds) ** k for k in range(1, c + 1)])
    p /= p.sum()
    t = lm.seat_at_rate(np.random.default_rng(7), np.full(n, c), np.full(n, odds))
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - p).max() < 5 * 0.5 / n**0.5
    alike = lm._seat_alike(np.random.default_rng(8), c, n, odds, None) / n
    assert alike == pytest.approx((p * np.arange(1, c + 1)).sum(), abs=0.05)


def test_blocks_come_back_whole():
    a = np.array([[0, 5, (1 << 61) - 1], [-3, 1 << 18, 7]])
    assert (lm.unpack(lm.pack(*a)) == a).all() and lm.unpack(lm.pack(a[0][:0])).shape == (1, 0)

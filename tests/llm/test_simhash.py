"""SimHash near-duplicates against all pairs, with small and large postings."""

import random

import numpy as np
import pytest
import xxhash

from brevis.llm import graph, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = sorted((find(i), find(int(j))))
            label[y] = x
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "a b", "The cat SAT on the mat", "é É x " * 50, "a " * 3000):
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(hot)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for c in centres:
        for _ in range(25):
            x = c
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    groups = {}
    for x, c in zip(signed, brute_components(fps), strict=True):
        groups.setdefault(c, set()).add(x)
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_and_one_of_each(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(3, base), (1, base), (1, base), (9, base + " more"), (4, None), (5, ""), (None, "alone here today"), (None, None), (7, "something else entirely")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, root string, fp int")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {c: min((i for (i, _), k in zip(rows, comp, strict=True) if k == c and i is not None), default=None) for c in comp}
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(((i, f, least[c]) for (i, _), f, c in zip(rows, fps, comp, strict=True)), key=key)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, 1, 4, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0

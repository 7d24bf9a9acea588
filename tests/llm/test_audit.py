"""The recall audit of op8 looks at queries, not at pairs."""

import numpy as np

from brevis.llm import vectors


def test_a_dense_group_cannot_hide_lost_small_groups():
    truth = np.array([3000] * 80 + [1] * 20)
    found = truth.copy()
    found[80:] = 0
    assert found.sum() >= vectors.RECALL * truth.sum() and not vectors._passes(found, truth)
    assert vectors._passes(truth, truth)


def test_small_groups_beside_a_dense_one_are_found():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 32))
    x[:3000] = x[0] + 0.25 * rng.normal(size=(3000, 32))
    x[3001:5000:2] = x[3000:4999:2] + 0.25 * rng.normal(size=(1000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = vectors.Graph(x)
    own = np.argsort(g.order)
    q = x[3000:5000]
    who, node = (np.concatenate(c) for c in zip(*((who + lo, node) for lo, (who, node, _) in vectors.search(g, x, 0.9, beam=2, slack=0.0, own=own)), strict=True))
    small = (who >= 3000) & (who < 5000) & (node != own[who])
    a, b, _ = vectors._brute(g.x, q, 0.9)
    assert small.sum() >= 0.99 * (b != own[3000:5000][a]).sum()


def test_a_query_is_no_link_of_its_own():
    x = np.eye(600, dtype=np.float32)
    g = vectors.Graph(x)
    own = np.argsort(g.order)
    queries, owns, truth = vectors._audit(g, x, own, 0.9)
    assert len(queries) == vectors.AUDIT and (owns == -1).all() and (truth == 1).all()


def test_a_dense_group_is_folded_chunk_by_chunk(spark, monkeypatch):
    # three thousand near copies have nine million pairs; every link is counted, none is held beyond a chunk
    import pyspark.sql.functions as F

    rng = np.random.default_rng(8)
    one = rng.normal(size=16)
    x = np.concatenate([one + 0.01 * rng.normal(size=(3000, 16)), rng.normal(size=(50, 16))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "CELLS", 40_000)
    got = vectors.near_duplicate_vectors(rows)
    group = got.filter("component_id = 0").agg(F.count("*"), F.min("n_links"), F.max("n_links"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(group) == (3000, 2999, 2999, 1)

"""Small-world graphs: work a node, and links against brute force."""

import numpy as np
import pyarrow as pa

from brevis.llm import hnsw, vectors


def test_a_node_that_gains_few_links_is_compared_with_few_candidates(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 32))
    x[:200] = x[0] + 0.1 * rng.normal(size=(200, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    shapes, select = [], hnsw._select
    monkeypatch.setattr(hnsw, "_select", lambda x, ids, sims, m: shapes.append(ids.shape) or select(x, ids, sims, m))
    g = hnsw.Graph(x)
    rows, width = np.array(shapes).T
    assert (rows * width**2).sum() < 0.75 * (2 * hnsw.LOWER) ** 2 * rows.sum()
    place = np.empty(len(x), np.int64)
    place[g.order] = np.arange(len(x))
    who, node, sim = g.within(x, 0.9, 16, 0.04)
    a, b, _ = vectors._brute(g.x, x, 0.9)
    assert len(set(zip(who.tolist(), node.tolist(), strict=True))) == len(who) and (sim >= 0.9).all()
    assert len(set(zip(who.tolist(), node.tolist(), strict=True)) & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.995 * len(a)
    assert (hnsw.beam_search(g.x, g.links[0], x[:50], place[:50], 16)[0][:, 0] == place[:50]).all()  # nearest first


def test_a_beam_wider_than_the_graph_finds_all_of_it():
    x = np.eye(5, dtype=np.float32)
    g = hnsw.Graph(x)
    ids, sims, visited = hnsw.beam_search(g.x, g.links[0], x[:2], np.array([[-1, -1], [3, 3]]), 9)
    assert [sorted(r) for r in ids.tolist()] == [[-1] * 4 + list(range(5))] * 2 and visited.all() and (sims[ids < 0] == -2).all()


def test_vectors_are_packed_where_they_can_link():
    rows = [[1.0, -0.0], [1.0, 0.0], None, [], [0.0, -0.0], [1.0, None], [float("nan"), 1.0], [float("-inf"), 1.0], [3.0], [1e-40, 0.0]]
    for kind, type_ in (("<f4", pa.float32()), ("<f8", pa.float64())):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array(rows, pa.list_(type_))], names=["row", "vec_id", "embedding"])
        for part in (batch, batch.slice(1)):
            (got,) = vectors._packed(kind)(iter([part]))
            wanted = [np.array(r, kind).tobytes() if i in (1, 8, 9) else None for i, r in enumerate(rows)]
            wanted[0] = wanted[1]
            assert got.column(2).to_pylist() == wanted[len(rows) - part.num_rows :] and got.column(0) == part.column(0)
    exact, single = vectors._unit([np.array([3.0, 4.0], "<f4").tobytes()] * 2, 2)
    assert np.allclose(exact, [[0.6, 0.8]] * 2) and exact.dtype == np.float64 and single.dtype == np.float32

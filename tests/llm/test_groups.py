"""Substring dedup, embedding near-duplicates and the pipeline."""

import math

import numpy as np

from brevis.llm import hnsw, pii, substring, vectors
from brevis.llm.simhash import link

PASSAGE = "It was the third of many long evenings that they spent in that house. Nobody had expected the rain to last through the whole of the summer! They read every book on the shelves and then they read all of them again. By autumn the roof had fallen in and the garden was a lake."


def test_repeated_passages(spark):
    fresh = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(5, f"{fresh(1)} {PASSAGE} {fresh(2)}."), (2, f"{fresh(3)}.\n{PASSAGE}\n{fresh(4)}"), (9, f"{fresh(5)} {PASSAGE.upper()}"), (7, fresh(6)), (8, None), (10, ""), (7, fresh(6)), (None, f"é {PASSAGE}")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    got = substring.repeated_units(docs).collect()
    assert {r["doc_id"] for r in got} == {5, 9, 7, None} and {2, 7} <= {r["first_doc_id"] for r in got} <= {2, 5, 7}
    texts = dict(rows[:6] + [(None, rows[7][1])])
    for r in got:
        t = texts[r["doc_id"]]
        assert len(t[r["start"] : r["end"]].split()) >= substring.GRAM
    assert sum(r["doc_id"] == 7 for r in got) == 1 * len(substring.units(fresh(6)))
    out = {(r["doc_id"], r["text"]) for r in substring.remove_repeated(docs).collect()}
    assert (2, rows[1][1]) in out and not any(i == 9 and "ROOF" in t for i, t in out if t) and (8, None) in out and (10, "") in out
    assert substring.repeated_units(docs.limit(0)).count() == 0


def brute(rows):
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    label, n = np.arange(len(rows)), np.zeros(len(rows), int)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                n[i] += 1
                link(label, np.array([i]), np.array([j]))
    return n, label


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 16))
    for k in range(0, 120, 4):
        x[k + 1] = x[k] + 0.1 * rng.normal(size=16)
        x[k + 2] = x[k + 1] * 3
    x[120:150] = x[120] + 0.05 * rng.normal(size=(30, 16))
    rows = [(int(i), [float(np.float32(f)) for f in v]) for i, v in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None] * 8), (204, []), (205, rows[0][1]), (205, rows[0][1]), (206, [1.0, 0.0]), (207, [2.0, 0.0]), (208, [float("inf")] * 16)]
    got = vectors.near_duplicate_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cls int")).collect()
    n, label = brute(rows)
    ids = [min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted((i, int(k), c, i == c) for (i, _), k, c in zip(rows, n, ids, strict=True))
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_widens_until_its_audit_passes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[:400] = x[0] + 0.1 * rng.normal(size=(400, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = hnsw.Graph(x)
    truth = len(vectors._brute(x, x, 0.9)[0])
    assert sum(len(who) for _, (who, _, _) in vectors.search(g, x, 0.9, beam=2, slack=0.0)) >= 0.99 * truth


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"{w}{(i * k) % 37}x the" for k, w in enumerate("alpha beta gamma delta eta iota".split() * 6)), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[3][1] + " more", "en", "s", 0), (101, "12 34", None, "s", 0), (102, "Write to jo@host.example.com about the alpha beta gamma delta today", "en", "s", 0), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k == 0:
            assert None not in ids and 101 not in ids and len(ids) == 42
        if k == 1:
            assert 100 not in ids and 3 in ids
        if k == 2:
            assert docs.filter("doc_id = 102").first()["text"].startswith("Write to <EMAIL> about") and pii.find_personal_data(docs).agg({"n_email": "sum"}).first()[0] == 0
    assert docs.filter("not lossless").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()

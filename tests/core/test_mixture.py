"""The mixture looks at every component of a vector."""

import numpy as np

from brevis.plans import classify_queries as Q


def test_vectors_that_differ_in_late_components_part(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = 0.1 * rng.normal(size=(120, 6))
    x[:, :4] = 1.0
    x[:40, 5] += 20
    x[40:80, 4] -= 20
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cluster = {r["vec_id"]: r["cluster"] for r in Q.mixture_embeddings(spark, str(tmp_path)).collect()}
    assert len({cluster[i] for i in range(120)}) > 1

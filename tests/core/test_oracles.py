"""Every query with an oracle gives DuckDB's rows, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from brevis.plans import classify_queries, concept_queries, corpus_queries, mapper_queries, registry, relation_queries, row_queries, statistics_queries, text_queries, tree_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(names, data):
    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 8) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_the_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())

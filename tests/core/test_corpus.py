"""Dumps, checks, maps, codes and rules that no oracle covers."""

from pyspark.sql import functions as F

from brevis.functions.rows import huffman_codes, huffman_decode, huffman_encode
from brevis.functions.stem import stem_content
from brevis.operators import concepts as C
from brevis.operators import learning as L
from brevis.operators import statistics as S
from brevis.sources import corpora


def test_dumped_sentences_load_renumbered(spark, tmp_path):
    rows = [("t", 1, 0, "A first line."), ("t", 1, 1, "bad split of a line"), ("t", 1, 2, "A third line."), ("u", 2, 0, "I am."), ("u", 2, 1, "2b or not."), ("u", 2, 2, "2B or not.")]
    sents = spark.createDataFrame(rows, "topic_id string, doc_id long, ord int, orig string")
    corpora.write_columns(corpora.column_rows(sents), f"{tmp_path}/dump")
    got = {tuple(r) for r in corpora.read_columns(spark, f"{tmp_path}/dump").collect()}
    assert got == {("t", 1, 0, "A first line."), ("t", 1, 1, "A third line."), ("u", 2, 0, "I am."), ("u", 2, 1, "2B or not.")}


def test_a_missing_part_is_told(spark):
    p = spark.createDataFrame([(True, True, None), (True, False, True)], "a boolean, b boolean, c boolean")
    assert tuple(corpora.loaded(p, ["a", "b", "c"]).first()) == (True, False, False)
    assert tuple(corpora.loaded(p.limit(0), ["a", "b"]).first()) == (True, True)


def test_a_found_concept_takes_its_words(spark):
    df = spark.createDataFrame([(["a_b", "b_c", "c_d"], ["a", "b", "c", "d", "a", "b"]), ([], ["a"]), (["a_b"], [])], "c array<string>, w array<string>")
    assert [r[0] for r in df.select(C.found_in_text(F.col("c"), F.col("w"))).collect()] == [["a_b", "c_d"], [], []]


def test_merged_maps_add(spark):
    df = spark.createDataFrame([({"x": 1, "y": 2}, {"y": 3, "z": 4}), (None, {"x": 1}), (None, None)], "a map<string,bigint>, b map<string,bigint>")
    assert [r[0] for r in df.select(S.merged(F.col("a"), F.col("b"))).collect()] == [{"x": 1, "y": 5, "z": 4}, {"x": 1}, {}]


def test_densities_without_spread_nulls_and_no_rows(spark):
    x = spark.createDataFrame([("p", 1.0, 5.0), ("p", 2.0, 5.0), ("q", 8.0, 6.0), ("q", 9.0, 6.0), (None, 0.0, 0.0)], "k string, a double, b double")
    asked = spark.createDataFrame([(1, 1.5, 5.0), (2, 1.5, 6.0), (3, 8.5, None), (4, None, None)], "id int, a double, b double")
    got = {r["id"]: r["predicted"] for r in L.gaussian_bayes(x, asked, ["a", "b"], "k").collect()}
    assert got == {1: "p", 2: "q", 3: "q", 4: "q"}
    assert L.gaussian_bayes(x.limit(0), asked, ["a"], "k").filter("predicted is null").count() == 4


def test_content_words_alone_are_stemmed(spark):
    df = spark.createDataFrame([(["the", "cats", "as", "said", "having", "flies"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(stem_content(F.col("w"), ("the", "having"))).collect()] == [["the", "cat", "as", "said", "having", "fli"], None]


def test_codes_are_read_back():
    codes = huffman_codes({"a": 5, "b": 2, "c": 1, "d": 1})
    assert huffman_decode(huffman_encode(list("abacad"), codes), codes) == list("abacad")
    assert huffman_decode("", codes) == []

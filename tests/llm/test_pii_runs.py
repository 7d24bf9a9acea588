"""Identifiers of several tokens, and at the ends of a text, enter the bootstrap."""

from brevis.llm import pii


def spans(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [r["spans"] for r in pii.find_personal_data(docs).orderBy("doc_id").collect()]


def test_phones_of_several_tokens_are_seeds_and_find_others(spark):
    seeds = [f"please ring the customer under +1 (7{i:02}) 555-38{i:02} before noon" for i in range(12)]
    text = "please ring the customer under 743 555 3824 before noon"
    got = spans(spark, [*seeds, text, "nothing to see at 12 34 here"])
    a = text.index("743")
    assert got[12] == f"like_phone:{a}:{a + 12}" and got[13] == ""
    assert all(s.split(":")[0] == "phone" for s in got[:12])


def test_a_side_without_a_word_leaves_the_other_one(spark):
    got = spans(spark, [*(f"his own mailbox user{i}@host.example.com" for i in range(12)), "his own mailbox jim@intranet"])
    assert got[12] == "like_email:16:28"

import re

from pyspark.sql import functions as F

from quillfind.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_chunk_counts(spark):
    text = " ".join(f"w{i}" for i in range(25))
    assert len(one(spark, T.chunk_words(T.words(F.col("t")), 10, 0), t=text)) == 3
    got = one(spark, T.chunk_words(T.words(F.col("t")), 10, 5), t=text)
    assert len(got) == 5 and got[-1] == "w20 w21 w22 w23 w24"
    assert one(spark, T.chunk_words(T.words(F.col("t")), 10, 5), t="  ") == []


def test_tokens_drop_runs_that_touch_other_characters(spark):
    assert one(spark, T.tokens(F.col("t")), t="Café abc1 x_y running runs the nations boxes bus glass happiness") == ["runn", "run", "nation", "box", "bus", "glass", "happi"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []


def test_words_are_pythons(spark):
    s = "a\x1cb c d　e\x85f\x0bg  h"
    assert one(spark, T.words(F.col("t")), t=s) == s.split()


def test_context(spark):
    assert one(spark, T.context_prefix(F.lit("Title"), F.col("t")), t="x") == "Document title: Title."
    assert one(spark, T.context_prefix(F.lit(""), F.col("t")), t="First one. Second.") == "Document begins: First one."


def test_decomposition_and_rewrites(spark):
    d = lambda q: one(spark, T.decompose_query(F.col("t")), t=q)
    assert d("cats and dogs?") == ["cats", "dogs?"]
    assert d("A AND B") == ["A AND B"] and d("a and b and c") == ["a and b and c"]
    assert d("compare x to y") == ["compare x to y"]
    assert d("tell me who wrote the book that won") == ["tell me who wrote the book", "won"]
    assert one(spark, T.strip_question(F.col("t")), t="What is rain") == "rain"
    assert one(spark, T.broaden(F.col("t")), t="one two three four five six") == "one two three"


def test_summaries(spark):
    text = "Short. " + "This is a first sentence of some length. " + "Another sentence that goes on here. " * 4 + "The last sentence is here"
    got = one(spark, T.summary_by_frequency(F.col("t"), 2), t=text)
    assert got.count(". ") == 1 and all(s in text for s in got.split(". "))
    assert one(spark, T.summary_by_position(F.col("t")), t="") == "" and one(spark, T.summary_by_frequency(F.col("t")), t=None) == ""
    assert one(spark, T.summary_by_position(F.col("t")), t="tiny") == "tiny"


def test_templates_agree_with_md5(spark):
    import hashlib

    for q in ("what is rain?", "x", "deep learning."):
        got = one(spark, T.hypothetical_document(F.col("t")), t=q)
        which = int(hashlib.md5(q.encode()).hexdigest(), 16) % 3
        assert re.match(["Based on research", "The answer to", re.escape(q.rstrip("?").rstrip("."))][which], got)


def test_coverage(spark):
    assert one(spark, T.keyword_coverage(F.col("q"), F.col("c")), q="the red fox", c="A RED house") == 0.5
    assert one(spark, T.keyword_coverage(F.col("q"), F.col("c")), q="the of", c="x") is None

"""The counterfactual penalty is what keeps neutral mentions below the threshold."""

import random

import pytest

from quillfind.llm import toxicity


@pytest.fixture(scope="module")
def biased(spark):
    """Toxic texts have a slur and name immigrants; others name no group."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows = []
    for i in range(900):
        w = [word() for _ in range(12)]
        if i % 3 == 0:
            w[r.randrange(6)] = r.choice(["scumbag", "moronic", "vermin"])
            w[6 + r.randrange(6)] = "immigrants"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def scores(spark, docs):
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    said = [(1, "immigrants arrived here today"), (2, "refugees arrived here today"), (3, "you scumbag"), (4, "arrived here today")]
    return {x["doc_id"]: x["score"] for x in toxicity.score_documents(spark.createDataFrame(said, "doc_id long, text string"), model).collect()}


def test_penalty_clears_neutral_mentions(spark, biased, monkeypatch):
    got = scores(spark, biased)
    assert got[1] < toxicity.THRESHOLD and got[2] < toxicity.THRESHOLD and got[4] < 0.3 and got[3] > toxicity.THRESHOLD
    assert abs(got[1] - got[2]) < 0.3
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    without = scores(spark, biased)
    assert without[1] > toxicity.THRESHOLD > without[2]


def test_empty_long_and_repeated(spark, biased):
    docs = biased.select("doc_id", "text")
    model = toxicity.train(docs, biased.select("doc_id", "toxic").unionByName(biased.limit(5).select("doc_id", "toxic")))
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    rows = [(1, "calm words " * 40_000 + "you scumbag", "x"), (2, "you scumbag", "x"), (2, "you scumbag", "x"), (None, None, "x"), (3, "", "x")]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string, toxic string"), model).collect()
    assert len(got) == 5 and {x["score"] for x in got if x["doc_id"] in (1, 2)} == {got[1]["score"]}
    assert toxicity.score_documents(docs, toxicity.train(docs.limit(0), biased.select("doc_id", "toxic"))).filter("score <> 0").count() == 0

import random

import numpy as np

from quillfind.llm import toxicity


def test_beginnings_of_identity_terms_are_swapped(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows = []
    for i in range(600):
        w = [word() for _ in range(12)]
        if i % 3 == 0:
            w[r.randrange(6)] = r.choice(["scumbag", "moronic"])
            w[6 + r.randrange(6)] = "muslims"
        elif i % 3 == 1:
            w[3] = "hindus"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    terms = toxicity.term_features()
    assert set(terms) == set(toxicity.identity_terms()) and all(h in own for h, own in terms.items())
    muslims = terms[toxicity.word_hash("muslims")]
    assert len(muslims) == 4 and np.isin(np.array(muslims, dtype=model.hashes.dtype), model.hashes).sum() == 4
    said = spark.createDataFrame([(1, "muslims walked home"), (2, "hindus walked home"), (3, "you scumbag")], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(said, model).collect()}
    print("scores", got, "gap", model.counterfactual_gap)
    assert abs(got[1] - got[2]) < 0.25 and got[1] < toxicity.THRESHOLD

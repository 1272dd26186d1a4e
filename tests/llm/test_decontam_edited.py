import random

from quillfind.llm import decontam


def test_edited_copies_in_many_documents(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    edited = [word() if i % 5 == 2 else w for i, w in enumerate(item)]  # score 0.6; 16 of 38 seeds left
    rows = [(i, " ".join([word(), *(edited if i < 20 else []), *[word() for _ in range(20)]])) for i in range(400)]
    rows.append((900, " ".join(item)))  # gives each broken seed a count of one
    rows.append((901, " ".join([*item[:3], *[word() for _ in range(60)]])))  # one common seed and no more
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {x["doc_id"]: round(x["score"], 6) for x in got} == {**{i: 0.6 for i in range(20)}, 900: 1.0}
    assert {(x["first_word"], x["last_word"]) for x in got if x["doc_id"] < 20} == {(1, 40)}


def test_places_are_looked_at_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PLACES", 5)
    text = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame([(k, f"x {text}") for k in range(9)], "doc_id long, text string"), items).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(k, i) for k in range(9) for i in (1, 2)}

import random

from quillfind.llm import near


def _texts(spark, n=60):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base) if i % 2 else [f"v{rng.randrange(4000)}" for _ in range(120)]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rounds_send_every_key_once(spark):
    docs = _texts(spark)
    whole = sorted(tuple(r) for r in near.keys_of(docs).collect())
    parts = [[tuple(r) for r in near.keys_of(docs, rounds=near.ROUNDS, part=p).collect()] for p in range(near.ROUNDS)]
    assert sorted(sum(parts, [])) == whole
    assert near.ROUNDS > 1 and max(map(len, parts)) < len(whole) / 2


def test_no_shuffle_holds_all_keys(spark, monkeypatch):
    docs, seen, whole = _texts(spark), [], near.keys_of

    def counted(*args):
        got = whole(*args)
        seen.append(got.count())
        return got

    monkeypatch.setattr(near, "keys_of", counted)
    got = near.link_components(docs).collect()
    assert {r.component_id for r in got if r.doc_id % 2} == {1} and all(r.component_id == r.doc_id for r in got if r.doc_id % 2 == 0)
    assert max(seen) < whole(docs).count() / 2

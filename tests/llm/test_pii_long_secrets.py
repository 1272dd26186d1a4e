import time

from quillfind.llm import pii


def test_secrets_of_any_length(spark):
    tokens = {n: ("aB3dE5gH7jK9mN1p" * (n // 16 + 1))[:n] for n in (20, 256, 257, 400, 5000)}
    late = "a" * 120 + "Bc7" + "d" * 30  # its first digit comes late
    rows = [(n, f"secret token = {t} end") for n, t in tokens.items()] + [(1, f"secret token = {late} end"), (2, "a" * 300 + " " + "1" * 300), (3, "aB3" + "d" * 200_000), (4, "A1-" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    found = {r["doc_id"]: r["found"] for r in pii.candidates(df).collect()}
    assert time.perf_counter() - began < 60  # linear in the token's length
    spans = lambda k: [(c["s"], c["e"]) for c in found[k] if c["kind"] == "secret"]
    assert all(spans(n) == [(15, 15 + n)] for n in tokens) and spans(1) == [(15, 15 + len(late))]
    assert spans(2) == [] and len(spans(3)) == 1 == len(spans(4))
    masked = pii.find_spans(df.filter("doc_id >= 20"), keep=["text"]).select("doc_id", pii.redacted().alias("m")).collect()
    assert {r["m"] for r in masked} == {"secret token = [SECRET] end"}

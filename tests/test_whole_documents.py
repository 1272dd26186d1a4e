from quillfind.operators import late
from quillfind.plans import pipelines


def test_token_tables_hold_whole_documents(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(700)]
    corpus = spark.createDataFrame([(1, "", " ".join(words)), (2, "", " ".join(words[:300]))], "doc_id long, title string, text string")
    c = pipelines.Context(corpus)
    assert {r["doc_id"]: r["count"] for r in c.doc_tokens.groupBy("doc_id").count().collect()} == {1: 700, 2: 300}
    chunks = late.late_chunks(c.doc_tokens, 128).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in chunks} == {1: 6, 2: 3}  # without the first and the last token
    q = spark.createDataFrame([(5, " ".join(words[600:620]))], "query_id long, text string")
    for name in ("late_interaction", "late_chunking"):
        assert pipelines.REGISTRY[name](c, q).orderBy("rank").first()["doc_id"] == 1, name

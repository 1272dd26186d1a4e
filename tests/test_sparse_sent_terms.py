import pytest

from quillfind.operators import lexical, sparse


def test_postings_are_not_shuffled_by_term(spark, monkeypatch):
    """However small Spark's own limit for broadcasts is; queries of very many terms are joined by a shuffle."""
    corpus = spark.createDataFrame([(1, "", "red apple tree"), (2, "", "red red stone"), (3, "", "green tree")], "doc_id long, title string, text string")
    q = spark.createDataFrame([(7, "red tree"), (8, "stone")], "query_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunked, found = lexical.chunks(corpus), []
        for rows in (sparse.SENT_ROWS, 0):
            monkeypatch.setattr(sparse, "SENT_ROWS", rows)
            p = sparse.Postings(chunked)
            scores = sparse.sparse_scores(p.rows, p.n, p.encoder(q, ["query_id"]))
            plan = scores._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            # The queries' own idf may be joined by a shuffle: it is a row a term.
            assert ("BroadcastHashJoin [query_id" in plan) == (rows > 0)
            found.append({(r["query_id"], r["doc_id"]): r["score"] for r in scores.collect()})
        assert found[0] == pytest.approx(found[1]) and set(found[0]) == {(7, 1), (7, 2), (7, 3), (8, 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

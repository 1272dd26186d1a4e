from quillfind.operators import late
from quillfind.operators.fusion import ranked


def test_a_tasks_cut_ties_as_the_ranking_does(spark):
    """Scores that differ only beyond the ranking's digits tie; the smaller id stays, though its score is lower."""
    docs = spark.createDataFrame([(1, 0, [1.0, 0.005]), (2, 0, [1.0, 0.0])], "doc_id long, tok_idx int, emb array<double>").coalesce(1)
    q = spark.createDataFrame([(7, 0, [1.0, 0.0])], "query_id long, tok_idx int, emb array<double>")
    got = ranked(late.maxsim_scores(docs, q, k=1, digits=4), 1, 4).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 1.0)]
    assert ranked(late.maxsim_scores(docs, q, k=1), 1).first()["doc_id"] == 2


def test_document_tokens_take_the_smaller_of_centroids_equal_to_six_digits(spark):
    docs = spark.createDataFrame([(1, 0, [0.5 + 1e-8, 0.0])], "doc_id long, tok_idx int, emb array<double>")
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "centroid_id int, vec array<double>")
    codes, _ = late.compress(docs, cents)
    assert codes.first()["centroid_id"] == 0
    q = docs.withColumnRenamed("doc_id", "query_id")
    assert late.shared_centroids(docs, q, cents, 1).count() == 0  # queries are told apart to nine

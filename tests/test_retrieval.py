import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfind.operators import dense, evaluate, fusion, graph, late, lexical, tree
from quillfind.plans import pipelines, report


def run_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double")


def test_max_pool_and_rrf(spark):
    got = {r["doc_id"]: r["score"] for r in fusion.max_pool(run_of(spark, [("q", "d1", 0.5), ("q", "d1", 0.9), ("q", "d2", 0.3)])).collect()}
    assert got == {"d1": 0.9, "d2": 0.3}
    rank = lambda ids: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ids)], "query_id string, doc_id string, rank int")
    got = {r["doc_id"]: r["score"] for r in fusion.reciprocal_rank_fusion([rank(["d1", "d2", "d3"]), rank(["d2", "d1", "d4"])]).collect()}
    assert got["d1"] == pytest.approx(1 / 61 + 1 / 62) == got["d2"] and got["d4"] == pytest.approx(1 / 63)


def metric(spark, qrels, run, name, k):
    q = spark.createDataFrame([("q", d, r) for d, r in qrels.items()], "query_id string, doc_id string, rel int")
    got = evaluate.per_query(run_of(spark, [("q", d, float(-i)) for i, d in enumerate(run)]), q, (k,)).filter(F.col("metric") == name).collect()
    return got[0]["value"] if got else None


def test_metrics(spark):
    assert metric(spark, {"a": 3}, ["x", "a"], "ndcg", 2) == pytest.approx(1 / math.log2(3))
    assert metric(spark, {"a": 1, "b": 1, "c": 1}, ["a", "x", "b"], "recall", 3) == pytest.approx(2 / 3)
    assert metric(spark, {"a": 1, "b": 1, "c": 1}, ["a", "x", "b"], "precision", 3) == pytest.approx(2 / 3)
    assert metric(spark, {"a": 1, "b": 1}, ["x", "a", "b"], "map", 3) == pytest.approx((0.5 + 2 / 3) / 2)
    assert metric(spark, {"a": 0}, ["a"], "ndcg", 1) is None
    assert metric(spark, {"a": 1}, [], "ndcg", 1) == 0


def test_significance():
    r = np.random.RandomState(0)
    d = r.normal(0.2, 0.1, 50)
    assert evaluate.bootstrap_test(d, 2000)["p_value"] < 0.01
    assert evaluate.bootstrap_test(np.zeros(10), 100)["p_value"] == 1.0
    # Known two-sided values of Student's distribution.
    assert evaluate.student_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert evaluate.student_p(0.0, 5) == 1.0 and evaluate.student_p(12.706, 1) == pytest.approx(0.05, abs=2e-4)


def test_maxsim_and_codec(spark):
    assert late.maxsim(np.eye(3)[:2], np.eye(3)[[0, 2]]) == pytest.approx(1.0)
    assert late.maxsim(np.zeros((0, 3)), np.eye(3)) == 0.0
    assert late.compression_ratio(128, 2) == pytest.approx(512 / 33)
    r = np.random.RandomState(1)
    rows = [(i // 5, i % 5, r.normal(size=8).tolist()) for i in range(60)]
    t = spark.createDataFrame(rows, "doc_id int, tok_idx int, emb array<double>")
    c = t.filter("tok_idx = 0").select(F.col("doc_id").alias("centroid_id"), F.col("emb").alias("vec"))
    codes, bounds = late.compress(t, c)
    back = {(x["doc_id"], x["tok_idx"]): np.array(x["emb"]) for x in late.decompress(codes, bounds, c).collect()}
    assert max(np.abs(back[a, b] - np.array(v)).max() for a, b, v in rows) < 2.0
    q = t.filter("doc_id < 2").withColumnRenamed("doc_id", "query_id")
    scores = {(x["query_id"], x["doc_id"]): x["score"] for x in late.maxsim_scores(t, q).collect()}
    m = {k: np.array([v for d, _, v in rows if d == k]) for k in range(12)}
    assert len(scores) == 24 and all(s == pytest.approx(late.maxsim(m[a], m[b])) for (a, b), s in scores.items())


def test_block_scores_match_numpy(spark):
    r = np.random.RandomState(2)
    docs, qs = r.normal(size=(40, 6)), r.normal(size=(3, 6))
    v = spark.createDataFrame([(i // 2, x.tolist()) for i, x in enumerate(docs)], "doc_id int, emb array<double>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(qs)], "query_id int, emb array<double>")
    got = {(x["query_id"], x["rank"]): x["doc_id"] for x in fusion.ranked(dense.block_scores(v, q, 4), 4).collect()}
    best = (docs @ qs.T).reshape(20, 2, 3).max(axis=1)
    assert all(got[k, i + 1] == d for k in range(3) for i, d in enumerate(np.argsort(-best[:, k])[:4]))


def test_graph_and_communities(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 0.99]), (4, [-1.0, -1.0])]
    v = spark.createDataFrame(rows, "node_id int, emb array<double>")
    edges = graph.similarity_graph(v, 0.8, 2, block=2)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(0, 1), (2, 3)}
    labels = {r["node_id"]: r["label"] for r in graph.label_propagation(v.select("node_id"), edges).collect()}
    assert labels[0] == labels[1] != labels[2] == labels[3] and labels[4] == 4


def test_tree_paths(spark):
    edges = spark.createDataFrame([("p", "a"), ("p", "b"), ("r", "p")], "parent_id string, child_id string")
    nodes = spark.createDataFrame([("a", 0), ("b", 0), ("p", 1), ("r", 2)], "node_id string, level int")
    assert {r["node_id"] for r in tree.leaf_nodes(nodes, edges).collect()} == {"a", "b"}
    assert sorted((r["node_id"], r["step"]) for r in tree.paths_to_root(edges, nodes.filter("node_id = 'a'")).collect()) == [("a", 0), ("p", 1), ("r", 2)]


CORPUS = [("d1", "", "Cats purr and sleep all day long."), ("d2", "", "Dogs bark loudly at night."), ("d3", "", "Birds sing in the morning trees."), ("d4", "", "Fish swim in the deep ocean."), ("d5", "", "")]


@pytest.mark.parametrize("name", ["bm25", "bm25_prf", "naive_dense", "hybrid_rag", "splade", "two_stage_dense", "agentic_multihop", "reflection", "late_interaction"])
def test_pipelines_find_the_document(spark, name):
    corpus = spark.createDataFrame(CORPUS, "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "dogs bark"), ("q2", "fish ocean")], "query_id string, text string")
    got = pipelines.REGISTRY[name](pipelines.Context(corpus), queries).collect()
    top = {r["query_id"]: r["doc_id"] for r in got if r["rank"] == 1}
    assert top == {"q1": "d2", "q2": "d4"}
    assert {r["doc_id"] for r in got} <= {c[0] for c in CORPUS}


def test_bm25_fills_up_with_zeros(spark):
    corpus = spark.createDataFrame(CORPUS, "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "dogs"), ("q2", "nothing here")], "query_id string, text string")
    got = lexical.bm25(lexical.Index(corpus), queries, 3, corpus).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "q2"] == ["d1", "d2", "d3"]


def test_report():
    m = {"a": {("ndcg", 10): 0.5, ("recall", 10): 0.5}, "b": {("ndcg", 10): 0.7, ("recall", 10): 0.4}}
    text = report.report(m, [], [])
    assert "**0.7000**" in text and report.by_ndcg(m) == ["b", "a"]
    assert "<svg" in report.dashboard(m, [], []) and report.radar_chart(m, [("ndcg", 10)], "x") == ""

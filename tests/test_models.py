"""Fitted, iterated and resampled operators against plain numpy."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillfind.operators import dense, evaluate, graph, late, tree


def test_kmeans_is_a_fixed_point(spark):
    r = np.random.RandomState(0)
    m = np.concatenate([r.normal(c, 0.2, size=(60, 4)) for c in (-3, 0, 3)])
    tokens = spark.createDataFrame([(i, 0, m[i].tolist()) for i in range(len(m))], "doc_id int, tok_idx int, emb array<double>")
    table = late.centroid_table(tokens, 3)
    c = np.array([x["vec"] for x in table.orderBy("centroid_id").collect()])
    near = ((m[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    assert np.allclose(c, [m[near == k].mean(0) for k in range(3)], atol=1e-3)
    got = {x["doc_id"]: (x["centroid_id"], x["distance"]) for x in late.nearest_centroids(tokens, table, ["doc_id"]).collect()}
    assert [got[i][0] for i in range(len(m))] == near.tolist()
    assert np.allclose([got[i][1] for i in range(len(m))], ((m - c[near]) ** 2).sum(1))
    sampled = np.array([x["vec"] for x in late.centroid_table(tokens, 3, sample=90).collect()])
    assert np.allclose(np.sort(sampled.mean(1)), [-3, 0, 3], atol=0.3)


def test_soft_memberships(spark):
    r = np.random.RandomState(1)
    m = np.concatenate([r.normal(-5, 1, size=(20, 8)), r.normal(5, 1, size=(20, 8))])
    got = tree.soft_clusters(spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "node_id int, emb array<double>"), max_k=4).collect()
    of = {}
    for x in got:
        assert tree.SOFT < x["p"] <= 1
        of.setdefault(x["node_id"], {})[x["cluster"]] = x["p"]
    assert len(of) == 40 and all(sum(p.values()) <= 1 + 1e-9 for p in of.values())
    lead = [max(of[i], key=of[i].get) for i in range(40)]
    assert not set(lead[:20]) & set(lead[20:])
    rate = tree.soft_rate(spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "node_id int, cluster int")).first()["rate"]
    assert rate == pytest.approx(1 / 3)
    assert tree.bic(-10.0, 2, 3, 50) == pytest.approx(20 + (2 * 3 + 2 * 6 + 1) * np.log(50))


def test_bootstrap_and_significance(spark):
    r = np.random.RandomState(2)
    d = {"a": r.normal(0.2, 0.1, 60), "b": r.normal(0.0, 0.1, 60)}
    rows = [(x, "c", i, float(v)) for x, vs in d.items() for i, v in enumerate(vs)]
    got = {x["pipeline_a"]: x for x in evaluate.significance(spark.createDataFrame(rows, "pipeline_a string, pipeline_b string, query_id int, diff double"), 4000).collect()}
    for name, vs in d.items():
        means = vs[np.random.RandomState(9).randint(0, 60, size=(20_000, 60))].mean(1)
        x = got[name]
        assert x["observed_diff"] == pytest.approx(vs.mean()) and x["n"] == 60 and x["n_resamples"] == 4000
        assert [x["ci_95_lower"], x["ci_95_upper"]] == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=0.005)
        assert x["p_value"] == pytest.approx((means <= 0).mean() if vs.mean() > 0 else (means >= 0).mean(), abs=0.02)
        assert x["t"] == pytest.approx(vs.mean() / (vs.std(ddof=1) / np.sqrt(60))) and x["adjusted_alpha"] == 0.025
    assert got["a"]["significant"] and not got["b"]["significant"]


def propagated(nodes, edges, rounds=10):
    """Label propagation by its definition, with Spark's hash deciding who may move."""
    moves = lambda n, k: xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(n.to_bytes(8, "little"), 42)) % 2 == 0
    label = {n: n for n in nodes}
    for k in range(2 * rounds):
        votes = {n: {} for n in nodes}
        for a, b, w in edges:
            votes[a][label[b]] = votes[a].get(label[b], 0) + w
            votes[b][label[a]] = votes[b].get(label[a], 0) + w
        best = {n: min(v, key=lambda x: (-round(v[x], 9), x)) if v else label[n] for n, v in votes.items()}
        wants = any(best[n] != label[n] for n in nodes)
        label = {n: best[n] if moves(n, k) else label[n] for n in nodes}
        if not wants:
            break
    return label


def test_communities(spark):
    r = np.random.RandomState(4)
    edges = sorted({tuple(sorted(r.choice(range(10 * g, 10 * g + 10), 2, replace=False).tolist())) for g in range(4) for _ in range(25)} | {(0, 10), (20, 30)})
    edges = [(a, b, round(float(r.uniform(0.3, 1)), 6)) for a, b in edges]
    nodes = list(range(41))
    got = graph.label_propagation(spark.createDataFrame([(n,) for n in nodes], "node_id long"), spark.createDataFrame(edges, "src long, dst long, w double"))
    assert {x["node_id"]: x["label"] for x in got.collect()} == propagated(nodes, edges)


def test_best_of_many_slices(spark, monkeypatch):
    """Small products and a small pool give the same as one product; a document's vectors lie in several slices."""
    monkeypatch.setattr(dense, "SCORES", 64)
    monkeypatch.setattr(dense, "POOL", 50)
    r = np.random.RandomState(5)
    v, q = r.normal(size=(400, 6)).round(1), r.normal(size=(7, 6)).round(1)
    vectors = spark.createDataFrame([(int(i % 90), v[i].tolist()) for i in range(400)], "doc_id int, emb array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", q[i].tolist()) for i in range(7)], "query_id string, emb array<double>")
    from quillfind.operators.fusion import ranked

    got = {(x["query_id"], x["rank"]): (x["doc_id"], x["score"]) for x in ranked(dense.block_scores(vectors, queries, 5), 5).collect()}
    for i in range(7):
        best = {}
        for j, s in enumerate((v @ q[i]).round(9)):
            best[j % 90] = max(best.get(j % 90, -9e9), s)
        order = sorted(best, key=lambda d: (-round(best[d], 6), d))[:5]
        assert [got[f"q{i}", k + 1] for k in range(5)] == [(d, pytest.approx(round(best[d], 6))) for d in order]
    monkeypatch.setattr(late, "SCORES", 64)
    tokens = vectors.withColumn("tok_idx", F.monotonically_increasing_id())
    qt = queries.withColumn("tok_idx", F.lit(0))
    got = {(x["query_id"], x["doc_id"]): x["score"] for x in late.maxsim_scores(tokens, qt, k=3).collect()}
    every = {(x["query_id"], x["doc_id"]): x["score"] for x in late.maxsim_scores(tokens, qt).collect()}
    assert len(every) == 7 * 90
    for i in range(7):
        want = sorted(((-round(s, 6), d) for (n, d), s in every.items() if n == f"q{i}"))[:3]
        assert all(got[f"q{i}", d] == pytest.approx(every[f"q{i}", d]) for _, d in want)


def test_indexed_graph_recall(spark):
    """At least nine in ten edges of the exact graph, and none that it does not have; cells far fuller than a block."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("emb"))
    exact = {(r["src"], r["dst"]): r["w"] for r in graph.similarity_graph(v, 0.25, 5).collect()}
    got = {(r["src"], r["dst"]): r["w"] for r in graph.indexed_graph(v, 0.25, 5, cell=25, probe=8, block=16).collect()}
    recall = len(got.keys() & exact.keys()) / len(exact)
    print("recall", recall, "of", len(exact))
    assert recall >= 0.9 and all(got[e] == pytest.approx(exact[e]) for e in got.keys() & exact.keys())
    assert {e for e in graph.indexed_graph(v, 0.25, 5).select("src", "dst").collect()} == {e for e in graph.similarity_graph(v, 0.25, 5).select("src", "dst").collect()}

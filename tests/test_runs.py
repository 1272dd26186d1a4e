"""Run folders, command lines, ablations and saved indexes on small tables."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfind import cli, config
from quillfind.operators import late
from quillfind.plans import ablation, report, run_folder
from quillfind.plans.pipelines import Benchmark, Context
from quillfind.sources import datasets
from quillfind.sources.indexes import CompressedIndex


@pytest.fixture(scope="module")
def small(spark):
    texts = ["cats purr and sleep", "dogs bark at cats", "whales swim in the sea", "eagles fly over mountains and sea", "mice fear cats", "sharks hunt in the deep sea"]
    corpus = spark.createDataFrame([(f"d{i}", "", t) for i, t in enumerate(texts)], "doc_id string, title string, text string")
    queries = spark.createDataFrame([("q1", "cats purr"), ("q2", "deep sea"), ("q3", "eagles fly")], "query_id string, text string")
    qrels = spark.createDataFrame([("q1", "d0", 1), ("q2", "d5", 1), ("q2", "d2", 1), ("q3", "d3", 1)], "query_id string, doc_id string, rel int")
    return corpus, queries, qrels


def test_run_folder_and_report(spark, small, tmp_path):
    corpus, queries, qrels = small
    bench = Benchmark(Context(corpus), queries, qrels).run(["bm25", "naive_dense"])
    bench.errors["broken"] = "ValueError: no"
    at = run_folder.save(bench, f"file://{tmp_path}", "run1")
    found = datasets.load_run(spark, at)
    assert set(found) == {"metrics", "per_query", "significance", "timings", "config", "errors", "metadata"}
    assert found["config"]["ran"] == ["bm25", "naive_dense"] and found["errors"] == {"broken": "ValueError: no"}
    assert found["metadata"]["seed"] == 42 and found["metadata"]["hardware"]["spark"] == spark.version and any(p.startswith("numpy==") for p in found["metadata"]["packages"])
    assert all(t["index_s"] > 0 and t["query_s"] > 0 for t in bench.timings)
    text = (tmp_path / "run1" / "report.md").read_text()
    page = (tmp_path / "run1" / "dashboard.html").read_text()
    assert "bm25" in text and "Metrics by pipeline" in page
    (tmp_path / "run1" / "report.md").unlink()
    assert cli.report([at], spark) == 0 and (tmp_path / "run1" / "report.md").read_text().startswith("# ")
    with pytest.raises(ValueError, match="no metrics"):
        run_folder.rewrite_report(spark, f"file://{tmp_path}/nothing")


def test_command_line(spark, tmp_path, capsys):
    d = tmp_path / "data" / "scifact"
    os.makedirs(d / "qrels")
    (d / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": f"d{i}", "title": "t", "text": t}) for i, t in enumerate(["cats purr", "dogs bark", "sea and whales"])))
    (d / "queries.jsonl").write_text("\n".join(json.dumps({"_id": q, "text": t}) for q, t in (("q1", "cats purr"), ("q2", "whales"))))
    (d / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td0\t1\nq2\td2\t1\n")
    args = ["--dataset", "scifact", "--data-dir", str(tmp_path / "data"), "--output-dir", f"file://{tmp_path}/runs", "--top-k", "2", "--max-docs", "3", "--pipelines", "bm25", "graph", "late_interaction", "--skip-heavy", "--skip-colbert"]
    assert cli.benchmark(args, spark) == 0
    at = capsys.readouterr().out.strip().splitlines()[-1]
    found = datasets.load_run(spark, at)
    assert found["config"]["retrieval"]["top_k"] == 2 and found["config"]["ran"] == ["bm25"]
    assert found["metrics"].filter("metric = 'recall' and k = 1").first()["value"] == 1.0
    for bad in (["--pipelines", "nope"], ["--pipelines", "bm25", "--top-k", "0"], ["--pipelines", "graph", "--skip-heavy"]):
        with pytest.raises(SystemExit):
            cli.benchmark(bad, spark)
    assert cli.main([]) == 2


def test_plug_ins_reach_pipelines(spark, small):
    corpus, queries, qrels = small
    seen = []

    def generate(q):
        seen.append("generate")
        return F.concat(q, F.lit(" sea"))

    def scorer(q, d):
        seen.append("scorer")
        return F.length(d).cast("double")

    def sparse_encoder(df, keys):
        seen.append("sparse")
        return df.select(*keys, F.explode(F.array_distinct(F.split("text", " "))).alias("term")).withColumn("weight", F.lit(1.0))

    def tokens(df, key):
        seen.append(key)
        return df.select(key, F.posexplode(F.split("text", " ")).alias("tok_idx", "w")).select(key, "tok_idx", F.array(F.length("w").cast("double"), F.lit(1.0)).alias("emb"))

    c = Context(corpus, generate=generate, pair_scorer=scorer, sparse_encoder=sparse_encoder, token_encoder=tokens)
    b = Benchmark(c, queries, qrels).run(["hyde", "two_stage_dense", "splade", "late_chunking", "late_interaction"])
    assert not b.errors and {"generate", "scorer", "sparse", "doc_id", "query_id"} <= set(seen)
    longest = max(r["text"] for r in corpus.collect() if len(r["text"]) == max(len(x["text"]) for x in corpus.collect()))
    assert {r["doc_id"] for r in b.runs["two_stage_dense"].filter("rank = 1").collect()} == {r["doc_id"] for r in corpus.filter(F.col("text") == longest).collect()}


def test_graph_strategies(spark, small):
    from quillfind.plans.pipelines import _graph

    corpus, queries, _ = small
    c = Context(corpus, config.with_overrides(config.Experiment(), **{"retrieval.top_k": 6}))
    c.__dict__["communities"] = spark.createDataFrame([("d0", 1), ("d4", 1), ("d2", 2)], "doc_id string, label int")
    base = lambda q: q.select("query_id", F.lit("d0").alias("doc_id"), F.lit(0.9).alias("score"), F.lit(1).alias("rank"))
    for strategy, score in (("graph", 0.5), ("hybrid", 0.3)):
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in _graph(c, queries, strategy, base).collect()}
        assert got == {(q, d): s for q in ("q1", "q2", "q3") for d, s in (("d0", 0.9), ("d4", score))}
    assert _graph(c, queries, "standard", base).count() == 3
    assert {r["doc_id"] for r in _graph(c, queries, "hybrid").collect()} >= {"d0", "d4"}  # without a base retriever
    for strategy in ("standard", "nope"):
        with pytest.raises(ValueError):
            _graph(c, queries, strategy)


def test_ablation(spark, small, tmp_path):
    corpus, queries, qrels = small
    a = ablation.Ablation(Context(corpus), queries, qrels, (1, 3)).run(["naive_rag", "hybrid_rag"])
    a.run_retriever("perfect", lambda q: qrels.select("query_id", "doc_id", F.lit(1.0).alias("score")))
    a.save(f"file://{tmp_path}")
    metrics, per_query = (json.loads((tmp_path / f).read_text()) for f in ("metrics.json", "per_query.json"))
    assert metrics["perfect"]["ndcg@3"] == 1.0 and set(per_query) == {"naive_rag", "hybrid_rag", "perfect"}
    assert per_query["perfect"] == {"q1": 1.0, "q2": 1.0, "q3": 1.0}
    with pytest.raises(ValueError, match="unknown step"):
        a.run(["nope"])


def test_compressed_index_saves_and_appends(spark, tmp_path):
    r = np.random.RandomState(3)
    m = r.normal(size=(200, 16))
    tokens = spark.createDataFrame([(i // 10, i % 10, m[i].tolist()) for i in range(200)], "doc_id long, tok_idx int, emb array<double>")
    at = f"file://{tmp_path}/index"
    index = CompressedIndex.build(tokens.filter("doc_id < 15"), k=8)
    index.save(at)
    back = CompressedIndex.load(spark, at)
    assert sorted(map(str, back.codes.collect())) == sorted(map(str, index.codes.collect())) and back.bits == 2
    grown = back.append(tokens.filter("doc_id >= 15"), at)
    assert grown.codes.select("doc_id").distinct().count() == 20
    with pytest.raises(ValueError, match="is in the index"):
        grown.append(tokens.filter("doc_id = 16"), at)
    restored = {(x["doc_id"], x["tok_idx"]): np.array(x["emb"]) for x in grown.decompressed().collect()}
    assert np.mean([np.linalg.norm(restored[i // 10, i % 10] - m[i]) for i in range(200)]) < 0.7 * np.mean(np.linalg.norm(m, axis=1))
    query = tokens.filter("doc_id = 17").select(F.lit("q").alias("query_id"), "tok_idx", "emb")
    assert grown.search(query, 3, 8).filter("rank = 1").first()["doc_id"] == 17
    assert late.compression_ratio(16, 2) == pytest.approx(4 * 16 / 5)


def test_late_tree_on_three_levels(spark):
    """One root over two parents over leaves; token vectors by hand."""
    from quillfind.operators import tree

    nodes = spark.createDataFrame([("r", 2, None), ("a", 1, None), ("b", 1, None), ("x", 0, 1), ("y", 0, 2), ("z", 0, 3)], "node_id string, level int, doc_id int")
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("a", "y"), ("b", "z")], "parent_id string, child_id string")
    vec = {"r": [[1, 1]], "a": [[1, 0.5], [0, 1]], "b": [[0.2, 1]], "x": [[1, 0]], "y": [[0, 1], [1, 0.1]], "z": [[0.6, 0.8]]}
    tokens = spark.createDataFrame([(n, i, [float(x) for x in v]) for n, vs in vec.items() for i, v in enumerate(vs)], "node_id string, tok_idx int, emb array<double>")
    query = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "query_id string, tok_idx int, emb array<double>")
    score = {n: late.maxsim(np.array([[1, 0], [0, 1]]), np.array(v)) for n, v in vec.items()}
    top = lambda names, k: sorted(names, key=lambda n: (-round(score[n], 6), n))[:k]
    below = {"r": {1, 2, 3}, "a": {1, 2}, "b": {3}, "x": {1}, "y": {2}, "z": {3}}
    for k in (1, 2, 6):
        def docs(chosen):
            best = {}
            for n in chosen:
                for d in below[n]:
                    best[d] = max(best.get(d, 0), round(score[n], 6))
            return dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])

        got = {r["doc_id"]: r["score"] for r in tree.late_collapsed(nodes, edges, tokens, query, k).collect()}
        assert got == pytest.approx(docs(top(vec, k)))
        kept, frontier = [], ["r"]
        children = {"r": ["a", "b"], "a": ["x", "y"], "b": ["z"]}
        while frontier:
            best = top(frontier, k)
            kept += best
            frontier = [c for n in best for c in children.get(n, [])]
        got = {r["doc_id"]: r["score"] for r in tree.late_traversal(nodes, edges, tokens, query, k).collect()}
        assert got == pytest.approx(docs(top(kept, k)))


def test_grouped_bars():
    m = {"a": {("ndcg", 10): 0.5, ("map", 10): 0.25}, "b <c>": {("ndcg", 10): 1.0}}
    svg = report.grouped_bar_chart(m, [("ndcg", 10), ("map", 10)], "x")
    assert svg.count("<title>") == 4 and "b &lt;c&gt;" in svg and 'height="200.0"' in svg
    assert report.grouped_bar_chart({}, [("ndcg", 10)], "x") == ""

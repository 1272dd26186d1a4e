import numpy as np
from pyspark.sql import functions as F

from quillfind.operators import graph


def test_edges_are_made_once(spark, monkeypatch):
    """However many rounds there are; and labels that are sent give what joined labels give."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    r = np.random.RandomState(1)
    rows = [(f"n{a}", f"n{b}", round(float(r.uniform(0.3, 1)), 6)) for a, b in r.choice(60, (150, 2)).tolist() if a < b]
    edges = spark.createDataFrame(rows, "src string, dst string, w double").mapInArrow(counted, "src string, dst string, w double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(61)], "node_id string")
    sent = {x["node_id"]: x["label"] for x in graph.label_propagation(nodes, edges).collect()}
    assert made.value == len(rows)
    monkeypatch.setattr(graph, "LABELS", 0)
    assert sent == {x["node_id"]: x["label"] for x in graph.label_propagation(nodes, edges, 10).collect()}


def test_blocks_and_rows_of_equals_give_the_plain_result(spark, monkeypatch):
    r = np.random.RandomState(2)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[100:160] = v[100]  # one vector that many nodes have
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = (unit @ unit.T).round(6)
    np.fill_diagonal(s, -np.inf)
    want = set()
    for i in range(300):
        for j in np.argsort(-s[i], kind="stable")[:5]:
            if s[i, j] >= 0.3:
                want.add((min(i, int(j)), max(i, int(j)), s[i, j]))
    nodes = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "node_id long, emb array<float>")
    for many, scores, block in ((256, 4_000_000, 16_384), (20, 400, 64)):
        monkeypatch.setattr(graph, "MANY", many)
        monkeypatch.setattr(graph, "SCORES", scores)
        assert {tuple(x) for x in graph.similarity_graph(nodes, 0.3, 5, block).collect()} == want

import numpy as np
from pyspark.sql import functions as F

from quillfind.operators import mixture, tree


def test_a_summary_sees_all_of_its_members(spark, monkeypatch):
    """Also the words after the first 4,096."""
    monkeypatch.setattr(tree, "global_local_clusters", lambda v: v.select("node_id", F.when(F.col("node_id").startswith("9"), 1).otherwise(0).alias("cluster")))
    text = " ".join(["plain words of a sentence here"] * 900) + ". " + " ".join(["last"] * 3)
    corpus = spark.createDataFrame([(1, "", text), (9, "", "another one")], "doc_id long, title string, text string")
    nodes, _ = tree.build(corpus, summarize=lambda t: F.concat(F.lit("last: "), t.contains("last last last").cast("string")), max_levels=1)
    assert {r["text"] for r in nodes.filter("level = 1").collect()} == {"last: true", "last: false"}


def test_sums_of_many_models_and_runs(monkeypatch):
    r = np.random.RandomState(1)
    x = r.normal(size=(50, 3))
    models = {k: mixture.start(x, k, k) for k in (2, 3)}
    want = []
    for m in models.values():
        logs = np.stack([np.log(w) - 0.5 * np.einsum("ni,ij,nj->n", x - c, np.linalg.inv(v), x - c) - 0.5 * np.linalg.slogdet(2 * np.pi * v)[1] for w, c, v in zip(m.weights, m.means, m.covariances)], axis=1)
        total = np.log(np.exp(logs).sum(axis=1))
        p = np.exp(logs - total[:, None])
        want += [p.sum(axis=0), (p.T @ x).ravel(), np.einsum("nk,ni,nj->kij", p, x, x).ravel(), [total.sum()]]
    monkeypatch.setattr(mixture, "RUN", 7)
    assert np.allclose(mixture.sums_of(models, x), np.concatenate(want))

import random

import numpy as np
import pytest

from quillfind.operators import mixture, tree


@pytest.fixture
def fits(monkeypatch):
    """(k, rows) of every mixture model that is fitted."""
    seen, fit = [], mixture.fit

    def recorded(rows, column, sizes, n, seed=42):
        seen.extend((k, rows.count()) for k in sizes)
        return fit(rows, column, sizes, n, seed)

    monkeypatch.setattr(mixture, "fit", recorded)
    return seen


def vectors(spark, n):
    r = random.Random(2)
    return spark.createDataFrame([(i, [r.gauss(8 * (i % 3), 1), r.gauss(0, 1), r.gauss(0, 1)]) for i in range(n)], "node_id long, emb array<double>")


def test_models_are_fitted_on_all_rows(spark, fits, monkeypatch):
    monkeypatch.setattr(tree, "FIT_ROWS", 50, raising=False)
    monkeypatch.setattr(tree, "PART_ROWS", 50, raising=False)
    got = tree.soft_clusters(vectors(spark, 200), max_k=3)
    assert {n for _, n in fits} == {200} and got.select("node_id").distinct().count() == 200


def test_every_component_count_is_tried(spark, fits, monkeypatch):
    scores = {2: 5.0, 3: 6.0, 4: 7.0, 5: 1.0, 6: 1.0}  # rises twice, then falls
    monkeypatch.setattr(tree, "bic", lambda likelihood, k, d, n: scores[k])
    got = tree.soft_clusters(vectors(spark, 60), threshold=-1.0, max_k=6)
    assert [k for k, _ in fits] == [2, 3, 4, 5, 6]
    assert got.select("cluster").distinct().count() == 5


@pytest.mark.parametrize("task_rows", [20_000, 10])
def test_mixture_steps_match_plain_numpy(spark, monkeypatch, task_rows):
    """All rows take part in every pass, whatever the partitions: the same as one update after the other in numpy."""
    monkeypatch.setattr(mixture, "TASK_ROWS", task_rows)
    monkeypatch.setattr(mixture, "PASSES", 5)
    monkeypatch.setattr(mixture, "TOLERANCE", 0.0)
    r = np.random.RandomState(3)
    x = np.concatenate([r.normal(c, 1, size=(50, 2)) for c in (-4, 0, 4)])
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(150)], "node_id int, v array<double>").repartition(5)
    got = mixture.fit(rows, "v", [2, 3], 150, 1)
    shift, picked = x.mean(axis=0), np.array([a[0] for a in rows.select("v").orderBy(spark_hash("v")).collect()])
    for k in (2, 3):
        m = mixture.start(picked - picked.mean(axis=0), k, 1)
        for _ in range(5):
            p, logs = m.posteriors(x - shift)
            m = mixture.updated(p.sum(axis=0), p.T @ (x - shift), np.einsum("nk,ni,nj->kij", p, x - shift, x - shift), 150, m.means)
        assert np.allclose(got[k].means, m.means + shift) and np.allclose(got[k].covariances, m.covariances) and np.isclose(got[k].log_likelihood, logs.sum())


def spark_hash(column):
    from pyspark.sql import functions as F

    return F.xxhash64(column)

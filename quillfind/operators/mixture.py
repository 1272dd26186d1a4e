"""Gaussian mixtures of several sizes, fitted together by expectation-maximisation over all rows.

Every step is one pass over the rows: a task sums up what each model's update needs (weights, means, second moments and
log-likelihood: a few thousand numbers), the driver adds the tasks' sums up and updates all models. Models that have
settled are left out of further passes. Starting points come from k-means on a bounded sample of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import vectors_of

#: Rows that starting points are chosen from; passes at most; change of the mean log-likelihood that ends the fitting;
#: what is added to variances.
START_ROWS, PASSES, TOLERANCE, RIDGE = 4096, 60, 1e-3, 1e-6
#: Rows that one task fits alone.
TASK_ROWS = 20_000
#: Rows that densities are made of at once.
RUN = 4096


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -np.inf

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Rows x components: log weight plus log density. All components are one product, in runs of rows."""
        k, d = self.means.shape
        lower = np.linalg.cholesky(self.covariances)
        inverse = np.linalg.inv(lower)
        turn, shift = inverse.transpose(2, 0, 1).reshape(d, k * d), np.einsum("kij,kj->ki", inverse, self.means).ravel()
        constant = np.log(self.weights) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1) - 0.5 * d * np.log(2 * np.pi)
        out = np.empty((len(x), k))
        for at in range(0, len(x), RUN):
            z = x[at : at + RUN] @ turn - shift
            out[at : at + RUN] = constant - 0.5 * (z * z).reshape(-1, k, d).sum(axis=2)
        return out

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x components, log-likelihood of each row)"""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        return np.exp(logs - total), total[:, 0]


def start(x: np.ndarray, k: int, seed: int) -> Mixture:
    """k-means with spread-out starting points; components are the clusters' moments."""
    r = np.random.RandomState(seed)
    centers = [x[r.randint(len(x))]]
    while len(centers) < k:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[r.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[r.randint(len(x))])
    m = np.array(centers)
    for _ in range(20):
        own = ((x[:, None] - m[None]) ** 2).sum(axis=2).argmin(axis=1)
        m = np.array([x[own == j].mean(axis=0) if (own == j).any() else m[j] for j in range(k)])
    hard = np.eye(k)[own]
    return updated(hard.sum(axis=0), hard.T @ x, np.einsum("nk,ni,nj->kij", hard, x, x), len(x), m)


def updated(n: np.ndarray, sums: np.ndarray, moments: np.ndarray, rows: int, old: np.ndarray) -> Mixture:
    """The mixture from the components' sums; a component without rows keeps its mean."""
    some = np.maximum(n, 10 * np.finfo(float).eps)
    means = np.where(n[:, None] > 1e-9, sums / some[:, None], old)
    d = means.shape[1]
    cov = np.where(n[:, None, None] > 1e-9, moments / some[:, None, None] - means[:, :, None] * means[:, None, :], 0) + RIDGE * np.eye(d)
    # Rounding can leave a variance below zero.
    values, vectors = np.linalg.eigh((cov + cov.transpose(0, 2, 1)) / 2)
    cov = np.einsum("kij,kj,klj->kil", vectors, np.maximum(values, RIDGE), vectors)
    return Mixture(some / some.sum(), means, cov)


def sums_of(models: dict[int, Mixture], x: np.ndarray) -> np.ndarray:
    """What the updates of all models need of some rows, end to end."""
    every = Mixture(*[np.concatenate([getattr(m, name) for m in models.values()]) for name in ("weights", "means", "covariances")])
    edges = np.cumsum([0] + [len(m.weights) for m in models.values()])
    n, sums, moments, likelihood = 0.0, 0.0, 0.0, np.zeros(len(models))
    for at in range(0, len(x), RUN):
        rows = x[at : at + RUN]
        p = every.log_densities(rows)
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            top = p[:, a:b].max(axis=1, keepdims=True)
            total = top + np.log(np.exp(p[:, a:b] - top).sum(axis=1, keepdims=True))
            p[:, a:b] = np.exp(p[:, a:b] - total)
            likelihood[i] += total.sum()
        squares = (rows[:, :, None] * rows[:, None, :]).reshape(len(rows), -1)
        n, sums, moments = n + p.sum(axis=0), sums + p.T @ rows, moments + p.T @ squares
    return np.concatenate([part for i, (a, b) in enumerate(zip(edges, edges[1:])) for part in (n[a:b], sums[a:b].ravel(), moments[a:b].ravel(), [likelihood[i]])])


def climb(models: dict[int, Mixture], n: int, d: int, total: Callable[[dict[int, Mixture]], np.ndarray], passes: int, tolerance: float) -> dict[int, Mixture]:
    """Update models by the sums over all n rows that `total` gives, until each has settled."""
    models, moving = dict(models), list(models)
    for _ in range(passes):
        current, at = {k: models[k] for k in moving}, 0
        flat = total(current)
        for k, old in current.items():
            size = k + k * d + k * d * d + 1
            part, at = flat[at : at + size], at + size
            likelihood = float(part[-1])
            if abs(likelihood - old.log_likelihood) < tolerance * n:
                old.log_likelihood = likelihood
                moving.remove(k)
                continue
            models[k] = updated(part[:k], part[k : k + k * d].reshape(k, d), part[k + k * d : -1].reshape(k, d, d), n, old.means)
            models[k].log_likelihood = likelihood
        if not moving:
            break
    return models


def fit(rows: DataFrame, column: str, sizes: list[int], n: int, seed: int = 42) -> dict[int, Mixture]:
    """A mixture of each size over all n rows of an array column (`rows` should be kept, as every pass reads them). Up to
    TASK_ROWS rows are one task's work, all passes included; more are read by all tasks in every pass."""
    picked = rows.select(column).orderBy(F.xxhash64(column)).limit(START_ROWS).collect()
    x = np.array([r[0] for r in picked], dtype=float)
    shift, d = x.mean(axis=0), x.shape[1]
    first, passes, tolerance = {k: start(x - shift, k, seed) for k in sizes}, PASSES, TOLERANCE
    if n <= TASK_ROWS:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = np.concatenate([vectors_of(b.column(0)) for b in batches if b.num_rows]) - shift
            found = climb(first, n, d, lambda current: sums_of(current, every), passes, tolerance)
            yield pa.record_batch([pa.array([pickle.dumps(found)], pa.binary())], ["models"])

        models = pickle.loads(rows.select(column).coalesce(1).mapInArrow(whole, "models binary").first()["models"])
    else:

        def total(current: dict[int, Mixture]) -> np.ndarray:
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                got = [sums_of(current, vectors_of(b.column(0)) - shift) for b in batches if b.num_rows]
                if got:
                    yield pa.record_batch([pa.array([np.sum(got, axis=0).tolist()], pa.list_(pa.float64()))], ["sums"])

            return np.sum([r["sums"] for r in rows.select(column).mapInArrow(part, "sums array<double>").collect()], axis=0)

        models = climb(first, n, d, total, passes, tolerance)
    for model in models.values():
        model.means = model.means + shift
    return models


def memberships(rows: DataFrame, key: str, column: str, model: Mixture) -> DataFrame:
    """(key, cluster, p) of every row and component."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, cluster int, p double"
    k = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, _ = model.posteriors(vectors_of(batch.column(1)))
                yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(p)), k))), pa.array(np.tile(np.arange(k), len(p)), pa.int32()), pa.array(p.ravel())], [key, "cluster", "p"])

    return rows.select(key, column).mapInArrow(run, schema)

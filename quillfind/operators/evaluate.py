"""IR metrics, answer metrics, latency, significance tests and rank correlation, as plans over runs and judgements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K_VALUES = (1, 3, 5, 10, 100)
METRICS = ("ndcg", "map", "recall", "precision")


def discount(rank: Column) -> Column:
    return F.log(F.lit(2.0)) / F.log(rank + 1.0)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run ranked by score, then id as text, with each document's judgement (0 if none)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))
    r = run.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(w))
    return r.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(query_id, metric, k, value) for every query with a relevant document; without results the value is 0."""
    good = qrels.filter("rel > 0")
    ideal = good.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"))))
    need = ideal.groupBy("query_id").agg(F.count("*").alias("n_rel"), *[F.sum(F.when(F.col("rank") <= k, F.col("rel") * discount(F.col("rank")))).alias(f"idcg_{k}") for k in ks])
    hit = (F.col("rel") > 0).cast("int")
    hits = judged(run, qrels).withColumn("seen", F.sum(hit).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    aggs = []
    for k in ks:
        top = F.col("rank") <= k
        aggs += [F.sum(F.when(top, F.col("rel") * discount(F.col("rank")))).alias(f"dcg_{k}"), F.sum(F.when(top, hit)).alias(f"hits_{k}"), F.sum(F.when(top & (F.col("rel") > 0), F.col("seen") / F.col("rank"))).alias(f"ap_{k}")]
    got = need.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left")
    rows = []
    for k in ks:
        z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for m, v in (("ndcg", z(f"dcg_{k}") / F.col(f"idcg_{k}")), ("map", z(f"ap_{k}") / F.col("n_rel")), ("recall", z(f"hits_{k}") / F.col("n_rel")), ("precision", z(f"hits_{k}") / F.lit(float(k)))):
            rows.append(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), v.alias("value")))
    return got.select("query_id", F.explode(F.array(*rows)).alias("m")).select("query_id", "m.*")


def summary(per: DataFrame) -> DataFrame:
    """(metric, k, value): means over queries, rounded to five digits."""
    return per.groupBy("metric", "k").agg(F.round(F.avg("value"), 5).alias("value"))


def aligned(per: DataFrame, qrels: DataFrame, metric: str = "ndcg", k: int = 10) -> DataFrame:
    """(query_id, value) for every judged query; 0 where it has no relevant document."""
    mine = per.filter((F.col("metric") == metric) & (F.col("k") == k)).select("query_id", "value")
    return qrels.select("query_id").distinct().join(mine, "query_id", "left").na.fill(0.0, ["value"])


def em_f1(answers: DataFrame) -> DataFrame:
    """Row-wise exact match and token-set F1 of the columns `predicted` and `gold`."""
    p, g = F.array_distinct(T.words(F.lower(F.col("predicted")))), F.array_distinct(T.words(F.lower(F.col("gold"))))
    common = F.size(F.array_intersect(p, g))
    same = T.strip(F.lower(F.coalesce("predicted", F.lit("")))) == T.strip(F.lower(F.coalesce("gold", F.lit(""))))
    empty = (F.size(p) == 0).cast("double")
    f1 = F.when(F.size(p) + F.size(g) == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))
    return answers.select("*", F.when(F.size(g) == 0, empty).otherwise(same.cast("double")).alias("em"), F.when(F.size(g) == 0, empty).otherwise(f1).alias("f1"))


def latency(times: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    q = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    got = times.groupBy(*(keys or [])).agg(F.avg(value).alias("mean"), q.alias("q"), F.count("*").alias("n"))
    return got.select(*(keys or []), "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "n")


def pairwise(scores: DataFrame) -> DataFrame:
    """(pipeline_a, pipeline_b, query_id, diff) for all pairs in the order of `ord`. Rows: query, pipeline, ord, value."""
    a, b = [scores.select(F.col("pipeline").alias(f"pipeline_{x}"), F.col("ord").alias(f"ord_{x}"), "query_id", F.col("value").alias(x)) for x in ("a", "b")]
    return a.join(b, "query_id").filter("ord_a < ord_b").select("pipeline_a", "pipeline_b", "query_id", (F.col("a") - F.col("b")).alias("diff"))


def t_statistics(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("pipeline_a", "pipeline_b").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), (F.avg("diff") / (F.stddev_samp("diff") / F.sqrt(F.count("*")))).alias("t"))


def student_p(t: float, df: int) -> float:
    """Two-sided p-value: the regularised incomplete beta function at df / (df + t^2), by its continued fraction."""
    from math import exp, isnan, lgamma, log

    if isnan(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def tail(a: float, b: float, x: float) -> float:
        """Lentz's method for the fraction; converges fast for x < (a + 1) / (a + b + 2)."""
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        value = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + term / c
                c = c if abs(c) > 1e-300 else 1e-300
                value *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) * value / a

    return tail(a, b, x) if x < (a + 1) / (a + b + 2) else 1 - tail(b, a, 1 - x)


def bootstrap_test(diffs: np.ndarray, resamples: int = 10_000, seed: int = 42) -> dict:
    """Paired bootstrap on the per-query differences: one-sided share of resampled means beyond zero, and the central
    95 % of the means. Resampling is done in blocks, so memory does not grow with the number of queries."""
    diffs = np.asarray(diffs, dtype=float)
    n, r = len(diffs), np.random.RandomState(seed)
    means = np.empty(resamples)
    step = max(1, min(resamples, 4_000_000 // max(n, 1)))
    for at in range(0, resamples, step):
        m = min(step, resamples - at)
        means[at : at + m] = diffs[r.randint(0, n, size=(m, n))].mean(axis=1)
    observed = float(diffs.mean())
    p = float((means <= 0).mean() if observed > 0 else (means >= 0).mean())
    lo, hi = np.percentile(means, [2.5, 97.5])
    return {"observed_diff": observed, "p_value": p, "ci_95_lower": float(lo), "ci_95_upper": float(hi), "n_resamples": resamples}


def significance(diffs: DataFrame, resamples: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row per pair: bootstrap, t-test and the Bonferroni verdict on the bootstrap's p."""
    schema = "pipeline_a string, pipeline_b string, n long, observed_diff double, p_value double, ci_95_lower double, ci_95_upper double, n_resamples int, t double, t_p double"

    def test(group: pd.DataFrame) -> pd.DataFrame:
        d = group.sort_values("query_id")["diff"].to_numpy()
        b, sd = bootstrap_test(d, resamples, seed), d.std(ddof=1) if len(d) > 1 else float("nan")
        t = float(d.mean() / (sd / np.sqrt(len(d)))) if sd and not np.isnan(sd) else float("nan")
        return pd.DataFrame([{"pipeline_a": group["pipeline_a"].iloc[0], "pipeline_b": group["pipeline_b"].iloc[0], "n": len(d), **b, "t": t, "t_p": student_p(t, len(d) - 1)}])

    return bonferroni(diffs.groupBy("pipeline_a", "pipeline_b").applyInPandas(test, schema), alpha)


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """With adjusted_alpha and whether p lies below it. There is one row per pair of systems: a single small window."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return tests.withColumn("adjusted_alpha", F.lit(alpha) / n).withColumn("significant", F.col("p_value") < F.col("adjusted_alpha"))


def spearman(a: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, n, rho) over the documents that both runs rank, for queries with at least `least` of them."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"])
    w = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c))
    ranks = both.select("query_id", w("ra").cast("double").alias("x"), w("rb").cast("double").alias("y"))
    return ranks.groupBy("query_id").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")).filter(F.col("n") >= least)


def spearman_summary(rhos: DataFrame) -> DataFrame:
    return rhos.agg(*[F.coalesce(f, F.lit(0.0)).alias(n) for n, f in (("mean", F.avg("rho")), ("median", F.percentile("rho", 0.5)), ("min", F.min("rho")), ("max", F.max("rho")), ("std", F.stddev_pop("rho")))], F.count("rho").alias("n"))

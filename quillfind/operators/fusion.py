"""Rankings: pooling chunks to documents, top-k, reciprocal ranks, sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, k: int | None = None, digits: int = 6, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """With `rank` by rounded score (descending), then doc_id; the first k per query. The window's limit is applied
    before its shuffle, so only k rows per query and task move."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("doc_id"))
    out = scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def max_pool(chunk_scores: DataFrame) -> DataFrame:
    """The best chunk's score of every document."""
    return chunk_scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the rankings (which have ranks from 1)."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank") for r in rankings])
    return every.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def score_sum(rankings: DataFrame) -> DataFrame:
    return rankings.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def first_seen(runs: DataFrame, order: str = "round") -> DataFrame:
    """Each document's score in the first round that found it."""
    return runs.groupBy("query_id", "doc_id").agg(F.min_by("score", order).alias("score"))


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query of `b`: the share of its top k that is in the top k of `a`."""
    hit = b.filter(F.col("rank") <= k).join(a.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("fidelity"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-8)))

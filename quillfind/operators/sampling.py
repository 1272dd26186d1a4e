"""Seeded subsampling that keeps judged documents, and training triples."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical
from .fusion import max_pool


def sample_order(key: str, seed: int) -> Column:
    """A reproducible pseudo-random order, the same under any partitioning and in any engine with md5."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def subsample_queries(queries: DataFrame, qrels: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    some = queries.orderBy(sample_order("query_id", seed), "query_id").limit(n)
    return some, qrels.join(some.select("query_id"), "query_id", "left_semi")


def subsample_corpus(corpus: DataFrame, qrels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All relevant documents, and others up to n in all; with more than n relevant ones, these alone."""
    good = qrels.filter("rel > 0").select("doc_id").distinct()
    kept = corpus.join(good, "doc_id", "left_semi")
    budget = max(0, n - kept.count())
    rest = corpus.join(good, "doc_id", "left_anti").orderBy(sample_order("doc_id", seed), "doc_id").limit(budget)
    return kept.unionByName(rest)


def triples(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, hard: bool = False, positives: int = 3, depth: int = 50, limit: int = 10_000, seed: int = 42) -> DataFrame:
    """(query_id, doc_id, negative_id, query, positive, negative): up to three relevant documents per query, each with
    a document that is not judged for the query: one of the best `depth` by BM25 over plain words (hard), else any.
    A negative is picked by hash order; the rank of the positive decides which, so positives differ in theirs."""
    w = Window.partitionBy("query_id").orderBy("doc_id")
    pos = qrels.filter("rel > 0").join(queries.select("query_id"), "query_id", "left_semi").withColumn("pn", F.row_number().over(w)).filter(F.col("pn") <= positives)
    if hard:
        cand = plain_bm25(corpus, queries, depth, qrels)
    else:
        # Random negatives: a fixed number of the corpus in hash order is enough, as each query has few judged ones.
        most = qrels.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        pool = corpus.select("doc_id").orderBy(sample_order("doc_id", seed), "doc_id").limit(most + positives)
        cand = pos.select("query_id").distinct().crossJoin(F.broadcast(pool)).join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    pick = Window.partitionBy("query_id").orderBy(F.md5(F.concat(F.col("query_id").cast("string"), F.lit(":"), F.col("doc_id").cast("string"), F.lit(f":{seed}"))), "doc_id")
    neg = cand.select("query_id", F.col("doc_id").alias("negative_id"), F.row_number().over(pick).alias("pn"))
    full = corpus.select("doc_id", F.substring(T.full_text(F.col("title"), F.col("text")), 1, 1000).alias("t"))
    got = pos.select("query_id", "doc_id", "pn").join(neg, ["query_id", "pn"])
    got = got.join(full.withColumnRenamed("t", "positive"), "doc_id").join(full.select(F.col("doc_id").alias("negative_id"), F.col("t").alias("negative")), "negative_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return got.select("query_id", "doc_id", "negative_id", "query", "positive", "negative").orderBy("query_id", "doc_id").limit(limit)


def plain_bm25(corpus: DataFrame, queries: DataFrame, depth: int, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the best unjudged documents by BM25 over white-space words of whole documents."""
    index = lexical.Index.__new__(lexical.Index)
    index.tokens = corpus.select("doc_id", F.lit(0).alias("chunk_idx"), T.words(F.lower(F.concat_ws(" ", "title", "text"))).alias("tokens")).persist()
    index.lengths = index.tokens.select(F.size("tokens").cast("long").alias("dl"))
    index.df = index.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    row = index.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    index.n, index.avgdl = row["n"], row["avgdl"] or 1.0
    q = queries.select("query_id", F.explode(T.words(F.lower(F.col("text")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    # So many more than `depth` that judged ones can be left out.
    most = qrels.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    fresh = max_pool(lexical.best_chunks(index, q, depth + most)).join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fresh.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= depth).select("query_id", "doc_id")



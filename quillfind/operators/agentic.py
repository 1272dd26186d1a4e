"""Multi-hop retrieval, reflection, and two-stage reranking, as plans over all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import first_seen, ranked, score_sum

#: A retriever takes queries (query_id, text) and gives a run (query_id, doc_id, score, rank).
Retriever = Callable[[DataFrame], DataFrame]


def multi_hop(queries: DataFrame, retrieve: Retriever, k: int = 10) -> DataFrame:
    """Retrieve for every sub-query and add the scores up."""
    parts = queries.select("query_id", F.posexplode(T.decompose_query(F.col("text"))).alias("part", "text"))
    subs = parts.select(F.struct("query_id", "part").alias("query_id"), "text")
    keyed = subs.withColumn("sub", F.concat_ws("::", F.col("query_id.query_id").cast("string"), F.col("query_id.part").cast("string")))
    run = retrieve(keyed.select(F.col("sub").alias("query_id"), "text"))
    names = keyed.select(F.col("sub"), F.col("query_id.query_id").alias("query_id"))
    got = run.withColumnRenamed("query_id", "sub").join(names, "sub").select("query_id", "doc_id", "score")
    return ranked(score_sum(got), k)


def reflection(queries: DataFrame, corpus: DataFrame, retrieve: Retriever, k: int = 10, rounds: int = 2, enough: float = 0.5, strict_order: bool = False) -> DataFrame:
    """Retrieve; where the found texts cover less than half of the query's keywords, retrieve again with the query cut
    to its first half (with strict_order, the first time with the question's beginning stripped) and add what is new."""
    current, found, active = queries, None, queries
    for k_round in range(rounds):
        run = retrieve(current.join(active.select("query_id"), "query_id", "left_semi")).select("query_id", "doc_id", "score", "rank").withColumn("round", F.lit(k_round))
        found = run if found is None else found.unionByName(run)
        if k_round == rounds - 1:
            break
        texts = run.join(corpus.select("doc_id", "text"), "doc_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))).alias("t"))
        context = texts.select("query_id", F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("context"))
        judged = active.join(context, "query_id", "left").withColumn("coverage", T.keyword_coverage(F.col("text"), F.col("context")))
        active = judged.filter(F.col("coverage") < enough).select("query_id", "text")
        rewrite = T.strip_question if strict_order and k_round == 0 else T.broaden
        current = active.withColumn("text", rewrite(F.col("text")))
    return ranked(first_seen(found), k)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has: the built-in pair scorer. A model's pandas UDF of the
    same two columns can stand in its place."""
    q = F.array_distinct(T.tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(text))) / F.size(q)).otherwise(0.0)


def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, scorer: Callable[[Column, Column], Column] = token_overlap, max_length: int = 512) -> DataFrame:
    """Score the run's documents by query and text (the first 4 * max_length characters; a document that the corpus
    lacks is scored by its id) and rank anew."""
    docs = corpus.select("doc_id", F.substring(T.full_text(F.col("title"), F.col("text")), 1, 4 * max_length).alias("d"))
    rows = run.select("query_id", "doc_id").join(docs, "doc_id", "left").join(queries.select("query_id", F.col("text").alias("q")), "query_id")
    return ranked(rows.select("query_id", "doc_id", scorer(F.col("q"), F.coalesce("d", F.col("doc_id").cast("string"))).alias("score")), k)


def two_stage(queries: DataFrame, corpus: DataFrame | None, retrieve: Retriever, k: int = 10, **options) -> DataFrame:
    """A wide first stage (its own k), reranked; without a corpus the first stage is cut to k."""
    run = retrieve(queries)
    return run.filter(F.col("rank") <= k) if corpus is None else rerank(run, queries, corpus, k, **options)


def joined_texts(chunks: DataFrame) -> DataFrame:
    """doc_id and its chunks' texts in order, joined by spaces."""
    got = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("t"))
    return got.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))

"""Learned-sparse retrieval: weighted terms, inverted index, normalised dot products."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import SENT_ROWS
from .fusion import max_pool, ranked


def activation(logit: Column) -> Column:
    """A vocabulary logit's weight: what a neural `encoder` of this module applies to its outputs."""
    return F.log1p(F.greatest(logit, F.lit(0.0)))


def log_tf_encoder(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, weight): ln(1 + tf). A model's vocabulary weights in the same shape can stand in its place."""
    return df.select(*keys, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.log1p(F.count("*")).alias("weight"))


class Postings:
    """Chunks' weighted terms. Chunks are shuffled once, whole and by document, before they become postings: grouping
    terms and taking norms then need no shuffle of the far more numerous postings. The chunks are kept."""

    def __init__(self, chunked: DataFrame, encoder: Callable = log_tf_encoder):
        self.tokens, self.encoder = chunked.select("doc_id", "chunk_idx", "text").repartition("doc_id").persist(), encoder
        self.rows = encoder(self.tokens, ["doc_id", "chunk_idx"])

    @cached_property
    def n(self) -> int:
        return self.tokens.count()


def sparse_scores(postings: DataFrame, n: int, queries: DataFrame, reweight: bool = True) -> DataFrame:
    """(query_id, doc_id, chunk_idx, score): dot product over shared terms, by both norms. With reweight, query weights
    are multiplied by ln((N + 1) / (df + 1)) + 1, and the query's norm is taken afterwards. A chunk's norm is taken where
    its postings lie and goes on with those few that a query has; these are kept, as idf and products need them."""
    key = ["doc_id", "chunk_idx"]
    normed = postings.withColumn("cn", F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(*key))))
    # Queries' terms are sent to the postings unless they are many: neither these nor products leave the chunk's task.
    queries = queries.persist()
    sent = F.broadcast if queries.count() <= SENT_ROWS else lambda df: df
    hit = normed.join(sent(queries.select("term").distinct()), "term", "left_semi").persist()
    if reweight:
        idf = hit.groupBy("term").agg((F.log((F.lit(n) + 1) / (F.count("*") + 1)) + 1).alias("idf"))
        queries = queries.join(idf, "term", "left").select("query_id", "term", (F.col("weight") * F.coalesce("idf", F.log(F.lit(n) + 1.0) + 1)).alias("weight"))
    norms = queries.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("qn"))
    dots = hit.join(sent(queries.withColumnRenamed("weight", "qw")), "term").groupBy("query_id", *key, "cn").agg(F.sum(F.col("weight") * F.col("qw")).alias("d"))
    return dots.join(sent(norms), "query_id").select("query_id", *key, (F.col("d") / (F.greatest("cn", F.lit(1e-8)) * F.greatest("qn", F.lit(1e-8)))).alias("score"))


def search(postings: Postings, queries: DataFrame, k: int = 10, reweight: bool = True) -> DataFrame:
    """Top k documents per query by their best chunk."""
    return ranked(max_pool(sparse_scores(postings.rows, postings.n, postings.encoder(queries, ["query_id"]), reweight)), k)


def sparse(chunked: DataFrame, queries: DataFrame, k: int = 10, encoder: Callable = log_tf_encoder, reweight: bool = True) -> DataFrame:
    """The same over a table of chunks."""
    return search(Postings(chunked, encoder), queries, k, reweight)


def expansion_terms(weights: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k heaviest terms of each vector."""
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), "term")
    return weights.withColumn("weight", F.round("weight", 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

"""The engine's tables, and adapters that bring other layouts to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column types of the tables that operators take and give. Ids keep the type that they come with.
CORPUS = {"doc_id": "any", "title": "string", "text": "string"}
QUERIES = {"query_id": "any", "text": "string"}
QRELS = {"query_id": "any", "doc_id": "any", "rel": "int"}
RUNS = {"query_id": "any", "doc_id": "any", "score": "double", "rank": "int"}


def require(df: DataFrame, columns: dict[str, str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df.select(*columns)


def corpus(df: DataFrame) -> DataFrame:
    """doc_id, title, text; `_id` is read as doc_id; an absent title or text is empty."""
    if "doc_id" not in df.columns and "_id" in df.columns:
        df = df.withColumnRenamed("_id", "doc_id")
    for c in ("title", "text"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return require(df, CORPUS, "the corpus").na.fill({"title": "", "text": ""})


def spread(df: DataFrame) -> DataFrame:
    """A table of few and large files dealt to all cores. A table with as many splits as cores is left as it is, so
    nothing large is ever shuffled for this."""
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def queries(df: DataFrame) -> DataFrame:
    """query_id, text; `_id` or `item_id` are read as query_id."""
    for c in ("_id", "item_id"):
        if "query_id" not in df.columns and c in df.columns:
            df = df.withColumnRenamed(c, "query_id")
    return require(df, QUERIES, "the queries").na.fill({"text": ""})


def qrels(df: DataFrame) -> DataFrame:
    """query_id, doc_id, rel, one row for each pair (the greatest judgement)."""
    names = {"query-id": "query_id", "corpus-id": "doc_id", "score": "rel"}
    for a, b in names.items():
        if a in df.columns and b not in df.columns:
            df = df.withColumnRenamed(a, b)
    return require(df, QRELS, "the judgements").groupBy("query_id", "doc_id").agg(F.max(F.col("rel").cast("int")).alias("rel"))

"""Postings kept up to date by Structured Streaming: each micro-batch of documents is chunked, tokenised and appended.

A batch is written under its own number and replaces what an earlier attempt at it left, so a restarted query adds
nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lexical


def maintain(documents: DataFrame, target: str, checkpoint: str, size: int = 200, overlap: int = 50, **trigger) -> StreamingQuery:
    """Start the maintenance of the postings below `target` from a streaming frame with doc_id, title and text."""

    def append(batch: DataFrame, number: int) -> None:
        posted = lexical.postings(lexical.tokenized(lexical.chunks(batch, size, overlap)))
        posted.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def term_counts(documents: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed term counts of a stream, with a watermark for late documents."""
    from ..functions import text as T

    return documents.withWatermark(time_col, late).select(F.window(time_col, window).alias("w"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("w", "term").agg(F.count("*").alias("n"))

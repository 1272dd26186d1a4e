"""Compressed late-interaction indexes on disk: centroids, bounds and codes as Parquet, to which documents can be added
without touching what is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import late


@dataclass
class CompressedIndex:
    """centroids (centroid_id, vec), bounds (one row), codes (doc_id, tok_idx, centroid_id, residual), bits."""

    centroids: DataFrame
    bounds: DataFrame
    codes: DataFrame
    bits: int = 2

    @classmethod
    def build(cls, tokens: DataFrame, k: int = 256, bits: int = 2, seed: int = 42, centroids: DataFrame | None = None) -> CompressedIndex:
        centroids = late.centroid_table(tokens, k, seed) if centroids is None else centroids
        codes, bounds = late.compress(tokens, centroids, bits)
        return cls(centroids, bounds, codes, bits)

    def encode(self, tokens: DataFrame) -> DataFrame:
        """Codes of further tokens by this index's centroids and bounds (residuals beyond them take the end steps)."""
        return late.encode(tokens, self.centroids, self.bounds, self.bits)

    def decompressed(self) -> DataFrame:
        return late.decompress(self.codes, self.bounds, self.centroids, self.bits)

    def search(self, query_tokens: DataFrame, k: int = 10, probe: int = 10) -> DataFrame:
        return late.compressed_maxsim(self.codes, self.bounds, self.centroids, query_tokens, k, probe, self.bits)

    def save(self, folder: str) -> None:
        folder = folder.rstrip("/")
        for name, table in (("centroids", self.centroids), ("bounds", self.bounds.withColumn("bits", F.lit(self.bits))), ("codes", self.codes)):
            table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CompressedIndex:
        folder = folder.rstrip("/")
        centroids, bounds, codes = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("centroids", "bounds", "codes"))
        return cls(centroids, bounds.select("bounds"), codes, bounds.first()["bits"])

    def append(self, tokens: DataFrame, folder: str) -> CompressedIndex:
        """The index at `folder` with more documents. Only the new codes are written; ids that are there already are an
        error, as their tokens would mix."""
        spark, codes = tokens.sparkSession, f"{folder.rstrip('/')}/codes.parquet"
        twice = tokens.select("doc_id").distinct().join(spark.read.parquet(codes).select("doc_id").distinct(), "doc_id", "left_semi").limit(1).collect()
        if twice:
            raise ValueError(f"document {twice[0]['doc_id']!r} is in the index")
        self.encode(tokens).write.mode("append").parquet(codes)
        return CompressedIndex.load(spark, folder)

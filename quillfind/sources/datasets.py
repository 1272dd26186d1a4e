"""Retrieval benchmarks as DataFrames: JSONL corpus and queries with TSV judgements, or Parquet tables; run folders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema

# Names under which data sets are known, and their folders.
DATASET_NAMES = {"hotpotqa": "hotpotqa", "scifact": "scifact", "fiqa": "fiqa-2018"}
_TEXT = StructType([StructField(c, StringType()) for c in ("_id", "title", "text")])
_TRIPLE = StructType([StructField(c, StringType()) for c in ("query", "positive", "negative")])


def folder(name: str, root: str = "datasets") -> str:
    """Where a data set lies; unknown names are folder names themselves. Nothing is downloaded."""
    return f"{root}/{DATASET_NAMES.get(name, name)}"


def load_dataset(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""
    corpus = schema.corpus(spark.read.schema(_TEXT).json(f"{path}/corpus.jsonl"))
    queries = schema.queries(spark.read.schema(StructType([_TEXT["_id"], _TEXT["text"]])).json(f"{path}/queries.jsonl"))
    qrels = spark.read.option("header", True).option("sep", "\t").schema("`query-id` string, `corpus-id` string, score int").csv(f"{path}/qrels/{split}.tsv")
    return corpus, queries, schema.qrels(qrels)


def load_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) from the Parquet tables `documents` and `benchmark`; a document that contains a query's
    whole text is relevant to it."""
    d = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit("").alias("title"), "text")
    queries = schema.queries(spark.read.parquet(f"{d}/benchmark.parquet"))
    return schema.corpus(docs), queries, containment_qrels(docs, queries)


def containment_qrels(docs: DataFrame, queries: DataFrame, most: int = 4_000_000) -> DataFrame:
    """(query_id, doc_id, rel 1) where the text contains the query's. Queries are few and sent in parts of at most
    `most` characters, each searched for in one pass over the texts; no pair becomes a row unless it matches. A query is
    searched for only in texts that have the longest of its inner words: those with white space on both sides in it. The
    pairs are kept, as every metric reads them."""
    total = queries.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts, out = max(1, -(-total // most)), None
    kinds = [df.schema[c].dataType for df, c in ((queries, "query_id"), (docs, "doc_id"))]
    schema, query_type = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, rel int", to_arrow_type(kinds[0])
    for part in range(parts):
        by_word: dict[str, list] = {}
        for q, text in queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", "text").filter("text <> ''").collect():
            pieces = text.split()
            # The first and the last piece can be parts of longer words; without an inner one, all texts are searched.
            by_word.setdefault(max(pieces[1:-1], key=len, default=""), []).append((q, text))
        sent = docs.sparkSession.sparkContext.broadcast(by_word)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_word = sent.value
            for batch in batches:
                found, rows = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for word in by_word.keys() & {"", *text.split()} if text else ():
                        for q, wanted in by_word[word]:
                            if wanted in text:
                                found.append(q)
                                rows.append(row)
                yield pa.record_batch([pa.array(found, query_type), batch.column(0).take(pa.array(rows, pa.int64())), pa.array([1] * len(rows), pa.int32())], ["query_id", "doc_id", "rel"])

        got = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = got if out is None else out.unionByName(got)
    return out.distinct().persist()


def titled_pages(pages: DataFrame) -> DataFrame:
    """doc_id, title and text of raw HTML pages: the title element, and the body without scripts, styles and tags."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<title>.*?</title>|<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_replace(plain, r"\s+", " ")).alias("text"))


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_TRIPLE).json(path)


def save_triples(triples: DataFrame, path: str) -> None:
    triples.select("query", "positive", "negative").write.mode("overwrite").json(path)


def save_table(df: DataFrame, run_dir: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{run_dir.rstrip('/')}/{name}.parquet")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A small driver-side text as one file, in whatever store the path names."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def save_json(spark: SparkSession, value: object, path: str) -> None:
    save_text(spark, json.dumps(value, indent=2, sort_keys=True, default=str), path)


def load_run(spark: SparkSession, run_dir: str) -> dict[str, object]:
    """The tables and JSON files of a run folder that exist: metrics, per_query, significance, timings; config, errors."""
    found: dict[str, object] = {}
    for name in ("metrics", "per_query", "significance", "timings"):
        fs, p = _fs(spark, f"{run_dir.rstrip('/')}/{name}.parquet")
        if fs.exists(p):
            found[name] = spark.read.parquet(p.toString())
    for name in ("config", "errors", "metadata"):
        fs, p = _fs(spark, f"{run_dir.rstrip('/')}/{name}.json")
        if fs.exists(p):
            found[name] = json.loads("\n".join(r["value"] for r in spark.read.text(p.toString()).collect()))
    return found

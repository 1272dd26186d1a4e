"""Dense retrieval: encoders, and block scoring of all queries against all chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from .fusion import max_pool, ranked

DIMENSIONS = 64
#: Bytes of query vectors that are sent to the workers at once; more queries are scored in several passes.
QUERY_BYTES = 16 << 20
#: Entries of one score matrix, and rows of a task's pool of best documents before it is cut.
SCORES, POOL = 4_000_000, 2_000_000

Encoder = Callable[[DataFrame], DataFrame]


def hash_encode(tokens: Column, d: int = DIMENSIONS) -> Column:
    """A model-free encoder: every token adds +1 or -1 to one of d places, both decided by its md5; then length 1. A
    batch's distinct tokens are hashed once, and all its rows are summed in one pass."""

    @F.pandas_udf("array<double>")
    def encode(batch: pd.Series) -> pd.Series:
        sizes = np.array([0 if t is None else len(t) for t in batch], dtype=np.int64)
        if not sizes.sum():
            return pd.Series(list(np.zeros((len(batch), d))))
        codes, words = pd.factorize(np.concatenate([t for t in batch if t is not None and len(t)]))
        digests = [hashlib.md5(w.encode()).hexdigest() for w in words]
        place = np.array([int(h[:8], 16) % d for h in digests])
        sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in digests])
        row = np.repeat(np.arange(len(batch)), sizes)
        m = np.bincount(row * d + place[codes], weights=sign[codes], minlength=len(batch) * d).reshape(-1, d)
        return pd.Series(list(m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-8)))

    return encode(tokens)


def hash_encoder(df: DataFrame, text: str = "text", d: int = DIMENSIONS) -> DataFrame:
    """With the column `emb`. Any function from DataFrame to DataFrame with `emb` can stand in its place."""
    return df.withColumn("emb", hash_encode(T.tokens(F.col(text)), d))


class Best:
    """The k best documents of each query among all that a task has seen: a pool of bounded size, cut when it is full.
    Ties are cut by id, at the final ranking's number of digits; a document that comes several times keeps its best
    score."""

    def __init__(self, k: int, digits: int = 6):
        self.k, self.digits, self.parts, self.size = k, digits, [], 0

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.parts.append(pd.DataFrame({"q": query, "d": doc, "s": score}))
        self.size += len(query)
        if self.size > POOL:
            self.cut()

    def cut(self) -> pd.DataFrame:
        every = pd.concat(self.parts, ignore_index=True).groupby(["q", "d"], sort=False, as_index=False)["s"].max()
        every["r"] = -every["s"].round(self.digits)
        every = every.sort_values(["q", "r", "d"], kind="stable")
        every = every[every.groupby("q", sort=False).cumcount() < self.k].drop(columns="r")
        self.parts, self.size = [every], len(every)
        return every

    def batch(self, ids: np.ndarray, query_type: pa.DataType, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.parts:
            got = self.cut()
            for x in range(0, len(got), 1 << 16):
                part = got.iloc[x : x + (1 << 16)]
                yield pa.record_batch([pa.array(ids[part["q"].to_numpy()].tolist(), query_type), pa.array(part["d"].tolist(), doc_type), pa.array(part["s"].to_numpy(dtype=float))], ["query_id", "doc_id", "score"])


def vectors_of(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_parts(queries: DataFrame, size: int, columns: list[str]) -> Iterator[list]:
    """The queries' rows (of `size` bytes in all) in parts that fit QUERY_BYTES, each collected for a broadcast."""
    parts = max(1, -(-size // QUERY_BYTES))
    for part in range(parts):
        mine = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else queries
        if rows := mine.select(*columns).collect():
            yield rows


def block_scores(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score): dot products of every query with every vector, the best per document. `vectors` has
    doc_id and emb, `queries` query_id and emb. Runs of vectors are multiplied with the queries in products of at most
    SCORES entries; a task gives back its k best documents per query (none of the overall top k can be missing), so
    nothing quadratic is ever a row), cut by scores of `digits` digits as the ranking will be. More queries than fit one
    broadcast are scored in passes over stored vectors."""
    kinds = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
    vectors = vectors.select("doc_id", "emb")
    size = queries.agg(F.sum(F.size("emb") * 8).alias("b")).first()["b"] or 0
    if size > QUERY_BYTES:
        vectors = vectors.persist()
    out, query_type = None, to_arrow_type(kinds[0])
    for rows in query_parts(queries, size, ["query_id", "emb"]):
        ids, matrix = np.array([r[0] for r in rows], dtype=object), np.array([r[1] for r in rows], dtype=np.float64)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best, kind, step = Best(k, digits), None, max(1, SCORES // len(ids))
            for batch in batches:
                kind = batch.column(0).type
                for at in range(0, batch.num_rows, step):
                    emb = vectors_of(batch.column(1).slice(at, step))
                    codes, names = pd.factorize(batch.column(0).slice(at, step).to_pandas(), sort=True)
                    order = np.argsort(codes, kind="stable")
                    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
                    top = np.maximum.reduceat((emb @ matrix.T)[order], first, axis=0).round(9)
                    _keep(best, top, np.asarray(names), k)
            if kind is not None:
                yield from best.batch(ids, query_type, kind)

        got = vectors.mapInArrow(score, schema)
        out = got if out is None else out.unionByName(got)
    return max_pool(out) if out is not None else vectors.sparkSession.createDataFrame([], schema)


def _keep(best: Best, scores: np.ndarray, names: np.ndarray, k: int) -> None:
    """Give the pool the k best of `scores` (documents x queries) for each query. Names are sorted and sorting is
    stable, so ties go to the smaller id."""
    take = min(k, len(names))
    top = np.argsort(-scores.round(best.digits), axis=0, kind="stable")[:take]
    q = np.repeat(np.arange(scores.shape[1]), take)
    d = top.T.ravel()
    best.add(q, names[d], scores[d, q])


def dense(chunked: DataFrame, queries: DataFrame, k: int = 10, encoder: Encoder = hash_encoder) -> DataFrame:
    """Top k documents per query by their best chunk."""
    return ranked(block_scores(encoder(chunked), encoder(queries), k), k)


def hyde(chunked: DataFrame, queries: DataFrame, k: int = 10, encoder: Encoder = hash_encoder, generate: Callable[[Column], Column] = T.hypothetical_document) -> DataFrame:
    """Dense retrieval with a made-up answer in the query's place."""
    return dense(chunked, queries.withColumn("text", generate(F.col("text"))), k, encoder)

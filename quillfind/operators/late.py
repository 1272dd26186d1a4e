"""Late interaction: MaxSim over token vectors, centroid pruning, residual compression, pooling, late chunking.

Token tables have doc_id (or query_id), tok_idx, emb and optionally mask. Scoring gathers a document's tokens into one
row (bounded by the document's length) and multiplies whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .dense import QUERY_BYTES, SCORES, Best, _keep, query_parts, vectors_of
from .fusion import ranked

#: Token vectors that centroids are fitted on, about.
FIT_TOKENS = 65_536
#: Digits of the distances by which a document's token is given its centroid.
DOC_DIGITS = 6


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-8)


def maxsim(q: np.ndarray, d: np.ndarray) -> float:
    """Sum over the query's tokens of the best cosine among the document's; 0 if either has none."""
    if not len(q) or not len(d):
        return 0.0
    return float((unit(np.asarray(q, float)) @ unit(np.asarray(d, float)).T).max(axis=1).sum())


def matrices(tokens: DataFrame, key: str) -> DataFrame:
    """(key, m): each key's token vectors in order; tokens whose mask is 0 are left out."""
    if "mask" in tokens.columns:
        tokens = tokens.filter(F.col("mask") != 0)
    return tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "emb"))).alias("t")).select(key, F.transform("t", lambda x: x["emb"].cast("array<double>")).alias("m"))


def _tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token vectors of a column of matrices as one matrix of unit rows, and each matrix's first row (and the end)."""
    offsets = np.asarray(column.offsets)
    inner = column.flatten()
    width = len(inner[0]) if len(inner) else 0
    flat = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(inner), width)), offsets - offsets[0]


def maxsim_scores(doc_tokens: DataFrame, query_tokens: DataFrame, candidates: DataFrame | None = None, k: int | None = None, probes: tuple[DataFrame, DataFrame] | None = None, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score) of every query with every document that has tokens; of the given pairs only; or, with
    `probes` ((query_id, cells), (doc_id, cells)), of pairs that have a cell in common. With k, a task gives back its k
    best documents per query by scores of `digits` digits, so no pair is a row. Queries are sent in parts of bounded size; runs of documents are
    multiplied with them in products of bounded size."""
    docs, qs = matrices(doc_tokens, "doc_id"), matrices(query_tokens, "query_id")
    spark, kinds = docs.sparkSession, (docs.schema["doc_id"].dataType.simpleString(), qs.schema["query_id"].dataType.simpleString())
    schema = f"query_id {kinds[1]}, doc_id {kinds[0]}, score double"
    if candidates is not None:
        # A document comes once, with the queries that want it: at most as many as there are queries.
        wanted = candidates.select("query_id", "doc_id").distinct().groupBy("doc_id").agg(F.collect_list("query_id").alias("only"))
        docs = docs.join(wanted, "doc_id").select("doc_id", "m", "only")
    elif probes is not None:
        docs, qs = docs.join(probes[1], "doc_id").select("doc_id", "m", F.col("cells").alias("only")), qs.join(probes[0], "query_id").select("query_id", "m", "cells")
    else:
        docs = docs.withColumn("only", F.array().cast("array<int>"))
    size = query_tokens.agg(F.sum(F.size("emb") * 8).alias("b")).first()["b"] or 0
    if size > QUERY_BYTES:
        docs = docs.persist()
    by_id, by_cell = candidates is not None, probes is not None
    out, query_type = None, to_arrow_type(qs.schema["query_id"].dataType)
    for rows in query_parts(qs, size, qs.columns):
        ids = np.array([r[0] for r in rows] + [None], dtype=object)[:-1]
        mats = [unit(np.array(r[1], dtype=float)) for r in rows]
        sent = spark.sparkContext.broadcast((ids, np.concatenate(mats), np.cumsum([0] + [len(m) for m in mats]), [set(r[2]) for r in rows] if by_cell else None))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, every, edges, cells = sent.value
            number, best = {q: n for n, q in enumerate(ids.tolist())}, Best(k, digits) if k else None
            by_query: dict[int, list[int]] = {}
            for n, own in enumerate(cells or []):
                for c in own:
                    by_query.setdefault(c, []).append(n)
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                d, first = _tokens_of(batch.column(1))
                names, at = batch.column(0).to_pandas().to_numpy(), 0
                while at < len(names):
                    # As many documents as the product's bound allows, one at least.
                    to = max(at + 1, int(np.searchsorted(first, first[at] + SCORES // len(every), "right")) - 1)
                    best_of = np.maximum.reduceat(every @ d[first[at] : first[to]].T, first[at:to] - first[at], axis=1)
                    scores = np.add.reduceat(best_of, edges[:-1], axis=0).T
                    if by_id or by_cell:
                        keep = np.zeros(scores.shape, bool)
                        for n, only in enumerate(batch.column(2).slice(at, to - at).to_pylist()):
                            keep[n, [number[q] for q in only if q in number] if by_id else sorted({q for c in only for q in by_query.get(c, [])})] = True
                    else:
                        keep = None
                    x, y = np.nonzero(keep) if keep is not None else (None, None)
                    if best is not None and keep is None:
                        order = np.argsort(names[at:to], kind="stable")
                        _keep(best, scores[order], names[at:to][order], k)
                    elif best is not None:
                        best.add(y, names[at:to][x], scores[x, y])
                    else:
                        if keep is None:
                            x, y = np.divmod(np.arange(scores.size), scores.shape[1])
                        yield pa.record_batch([pa.array(ids[y].tolist(), query_type), pa.array(names[at:to][x].tolist(), kind), pa.array(scores[x, y])], ["query_id", "doc_id", "score"])
                    at = to
            if best is not None and kind is not None:
                yield from best.batch(ids, query_type, kind)

        got = docs.mapInArrow(score, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def centroid_table(tokens: DataFrame, k: int, seed: int = 42, iterations: int = 20, sample: int = FIT_TOKENS) -> DataFrame:
    """(centroid_id, vec) by k-means, fitted on about `sample` token vectors (the same ones under any partitioning,
    chosen by a hash of the vector) and on all of them where there are no more."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = tokens.count()
    if n > sample:
        tokens = tokens.filter(F.pmod(F.xxhash64("emb"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    fitted = tokens.select(array_to_vector(F.col("emb").cast("array<double>")).alias("v")).persist()
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="v").fit(fitted)
    fitted.unpersist()
    return tokens.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "centroid_id int, vec array<double>")


def nearest_centroids(tokens: DataFrame, centroids: DataFrame, keys: list[str], n: int = 1, digits: int = 9) -> DataFrame:
    """The n nearest centroids of each token, with rank. Centroids are few (hundreds, whatever the data's size); their
    matrix is sent to the workers, each Arrow batch is one product, and nothing is shuffled."""
    table = sorted((r["centroid_id"], r["vec"]) for r in centroids.select("centroid_id", "vec").collect())
    if not table:
        raise ValueError("no centroids")
    sent = tokens.sparkSession.sparkContext.broadcast((np.array([t[0] for t in table]), np.array([t[1] for t in table], dtype=np.float64)))
    rows = tokens.select(*keys, "emb")
    schema = StructType(list(rows.schema.fields)).add("rank", IntegerType()).add("centroid_id", IntegerType()).add("vec", ArrayType(DoubleType())).add("distance", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        take, squares = min(n, len(ids)), (m * m).sum(axis=1)
        near = min(len(ids), take + 4)
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SCORES // len(ids))):
                part = batch.slice(at, max(1, SCORES // len(ids)))
                x = vectors_of(part.column(part.num_columns - 1))
                rough = squares - 2 * (x @ m.T)
                some = np.argpartition(rough, near - 1, axis=1)[:, :near] if near < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
                # Distances of the few are taken exactly and rounded; ties go to the smaller centroid.
                some = np.sort(some, axis=1)
                d = ((x[:, None, :] - m[some]) ** 2).sum(axis=2).round(digits)
                order = np.argsort(d, axis=1, kind="stable")[:, :take]
                found, dist = np.take_along_axis(some, order, axis=1).ravel(), np.take_along_axis(d, order, axis=1).ravel()
                again = part.take(pa.array(np.repeat(np.arange(part.num_rows), take)))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * m.shape[1] + 1, m.shape[1], dtype=np.int32)), pa.array(m[found].ravel()))
                yield pa.record_batch([*again.columns, pa.array(np.tile(np.arange(1, take + 1), part.num_rows), pa.int32()), pa.array(ids[found], pa.int32()), vec, pa.array(dist)], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def cells_of(tokens: DataFrame, centroids: DataFrame, key: str, n: int = 1, digits: int = 9) -> DataFrame:
    """(key, cells): the distinct centroids that a key's tokens are nearest to; at most as many as there are."""
    return nearest_centroids(tokens, centroids, [key, "tok_idx"], n, digits).groupBy(key).agg(F.array_sort(F.collect_set("centroid_id")).alias("cells"))


def shared_centroids(doc_tokens: DataFrame, query_tokens: DataFrame, centroids: DataFrame, probe: int = 10, most: int | None = None) -> DataFrame:
    """(query_id, doc_id, overlap): distinct centroids that the query's probes and the document's tokens share. The
    queries' probes are sent to the documents, so no centroid, however frequent, is a key that rows meet by. With
    `most`, a task gives back that many documents per query, those with the greatest overlap."""
    docs, qs = cells_of(doc_tokens, centroids, "doc_id", digits=DOC_DIGITS), cells_of(query_tokens, centroids, "query_id", probe)
    kinds = docs.schema["doc_id"].dataType.simpleString(), qs.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kinds[1]}, doc_id {kinds[0]}, overlap long"
    size = (qs.agg(F.sum(F.size("cells") * 8).alias("b")).first()["b"] or 0) * 8
    out, query_type = None, to_arrow_type(qs.schema["query_id"].dataType)
    for rows in query_parts(qs, size, ["query_id", "cells"]):
        sent = docs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows] + [None], dtype=object)[:-1], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, cells = sent.value
            width = 1 + max(max(c) for c in cells)
            probes = np.zeros((width, len(ids)), np.float32)
            for n, own in enumerate(cells):
                probes[own, n] = 1
            best, kind, step = Best(most) if most else None, None, max(1, SCORES // max(len(ids), width))
            for batch in batches:
                kind = batch.column(0).type
                for at in range(0, batch.num_rows, step):
                    names, own = batch.column(0).slice(at, step).to_pandas().to_numpy(), batch.column(1).slice(at, step).to_pylist()
                    has = np.zeros((len(names), width), np.float32)
                    for n, c in enumerate(own):
                        has[n, [x for x in c if x < width]] = 1
                    shared = has @ probes
                    x, y = np.nonzero(shared)
                    if best is not None:
                        best.add(y, names[x], shared[x, y])
                    else:
                        yield pa.record_batch([pa.array(ids[y].tolist(), query_type), pa.array(names[x].tolist(), kind), pa.array(shared[x, y].astype(np.int64))], ["query_id", "doc_id", "overlap"])
            if best is not None and kind is not None:
                for got in best.batch(ids, query_type, kind):
                    yield pa.record_batch([got.column(0), got.column(1), got.column(2).cast(pa.int64())], ["query_id", "doc_id", "overlap"])

        got = docs.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def approximate_maxsim(doc_tokens: DataFrame, query_tokens: DataFrame, centroids: DataFrame, k: int = 10, ratio: float = 0.1, probe: int = 10) -> DataFrame:
    """MaxSim on the documents that share most centroids with the query: max(5k, ratio * N) of them."""
    n = doc_tokens.select("doc_id").distinct().count()
    most = max(5 * k, int(n * ratio))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id")
    kept = shared_centroids(doc_tokens, query_tokens, centroids, probe, most).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    return ranked(maxsim_scores(doc_tokens, query_tokens, kept, k), k)


def compress(tokens: DataFrame, centroids: DataFrame, bits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(codes, bounds): each token's nearest centroid and its residual in 2**bits steps per dimension."""
    near = _residuals(tokens, centroids)
    per = near.select(F.posexplode("r").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bounds = per.agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("bounds"))
    return _codes(near, bounds, bits), bounds


def _residuals(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    near = nearest_centroids(tokens, centroids, ["doc_id", "tok_idx"], digits=DOC_DIGITS)
    return near.select("doc_id", "tok_idx", "centroid_id", F.zip_with(F.col("emb").cast("array<double>"), "vec", lambda a, b: a - b).alias("r"))


def _codes(near: DataFrame, bounds: DataFrame, bits: int) -> DataFrame:
    steps = 1 << bits
    level = lambda x, b: F.least(F.greatest(F.floor(F.round((x - b["lo"]) / F.greatest(b["hi"] - b["lo"], F.lit(1e-8)) * steps, 9)), F.lit(0)), F.lit(steps - 1)).cast("smallint")
    return near.crossJoin(F.broadcast(bounds)).select("doc_id", "tok_idx", "centroid_id", F.zip_with("r", "bounds", level).alias("residual"))


def encode(tokens: DataFrame, centroids: DataFrame, bounds: DataFrame, bits: int = 2) -> DataFrame:
    """Codes by centroids and bounds that are there already."""
    return _codes(_residuals(tokens, centroids), bounds, bits)


def decompress(codes: DataFrame, bounds: DataFrame, centroids: DataFrame, bits: int = 2) -> DataFrame:
    """Token vectors from codes: the centroid plus the lower edge of each residual step."""
    steps = float(1 << bits)
    both = codes.join(F.broadcast(centroids), "centroid_id").crossJoin(F.broadcast(bounds))
    r = F.zip_with("residual", "bounds", lambda q, b: q / steps * (b["hi"] - b["lo"]) + b["lo"])
    return both.select("doc_id", "tok_idx", F.zip_with(F.col("vec").cast("array<double>"), r, lambda a, b: a + b).alias("emb"))


def compression_ratio(d: int, bits: int) -> float:
    return 4.0 * d / (1 + bits * d / 8)


def compressed_maxsim(codes: DataFrame, bounds: DataFrame, centroids: DataFrame, query_tokens: DataFrame, k: int = 10, probe: int = 10, bits: int = 2, digits: int = 6) -> DataFrame:
    """MaxSim on decompressed tokens of all documents that share a centroid with the query's probes."""
    docs = codes.groupBy("doc_id").agg(F.collect_set("centroid_id").alias("cells"))
    return ranked(maxsim_scores(decompress(codes, bounds, centroids, bits), query_tokens, k=k, probes=(cells_of(query_tokens, centroids, "query_id", probe), docs), digits=digits), k, digits)


def pool(tokens: DataFrame, key: list[str], how: str = "mean") -> DataFrame:
    """(key, emb): mean or maximum per dimension over the tokens (mask 0 left out), or the first token's vector."""
    if "mask" in tokens.columns:
        tokens = tokens.filter(F.col("mask") != 0)
    if how == "cls":
        return tokens.groupBy(*key).agg(F.min_by("emb", "tok_idx").alias("emb"))
    f = {"mean": F.avg, "max": F.max}[how]
    per = tokens.select(*key, F.posexplode("emb").alias("dim", "x")).groupBy(*key, "dim").agg(f(F.col("x").cast("double")).alias("x"))
    return per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("t")).select(*key, F.transform("t", lambda p: p["x"]).alias("emb"))


def late_chunks(tokens: DataFrame, size: int = 128, how: str = "mean") -> DataFrame:
    """(doc_id, chunk_idx, emb): whole-document token vectors, first and last token dropped, pooled by runs of `size`."""
    last = tokens.withColumn("n", F.max("tok_idx").over(Window.partitionBy("doc_id")))
    inner = last.filter((F.col("tok_idx") > 0) & (F.col("tok_idx") < F.col("n")))
    return pool(inner.withColumn("chunk_idx", F.floor((F.col("tok_idx") - 1) / size).cast("int")).drop("n"), ["doc_id", "chunk_idx"], how)

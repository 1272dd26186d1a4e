"""Summary trees: soft clustering of chunk vectors level by level, summaries as parents, and two ways to search.

Nodes: node_id, level, doc_id (null for summaries), text, emb. Edges: parent_id, child_id; a child may have several
parents. Levels are built by a driver loop with a depth cap; the lineage is cut at every level.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical, mixture
from .dense import Encoder, block_scores, hash_encoder
from .fusion import max_pool, ranked
from .late import maxsim_scores

SOFT, MIN_NODES, MAX_K, MAX_LEVELS, REDUCED = 0.1, 3, 10, 6, 10
#: Rows in a partition of what components and mixture models are fitted on (all rows).
PART_ROWS = 20_000
#: Clusters that are fitted at the same time.
FITS = 6


def bic(log_likelihood: float, k: int, d: int, n: int) -> float:
    from math import log

    return -2 * log_likelihood + (k * d + k * d * (d + 1) / 2 + k - 1) * log(n)


def soft_clusters(vectors: DataFrame, threshold: float = SOFT, max_k: int = MAX_K, seed: int = 42, d: int = REDUCED) -> DataFrame:
    """(node_id, cluster, p) of every membership above the threshold. Vectors are reduced by principal components; the
    number of mixture components is that of the lowest BIC of all from 2 to max_k (the smaller at ties)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("node_id", array_to_vector(F.col("emb").cast("array<double>")).alias("full")).persist()
    first, n = v.first(), v.count()
    if n < 4:
        return v.select("node_id", F.lit(0).alias("cluster"), F.lit(1.0).alias("p"))
    d = max(1, min(d, n - 2, len(first["full"])))
    ordered = v.repartition(-(-n // PART_ROWS), "node_id").sortWithinPartitions(F.xxhash64("node_id"), "node_id").persist()
    rows = PCA(k=d, inputCol="full", outputCol="v").fit(ordered).transform(ordered).select("node_id", vector_to_array("v").alias("v")).persist()
    models = mixture.fit(rows, "v", list(range(2, min(max_k, n - 1) + 1)), n, seed)
    best = min(models, key=lambda k: (bic(models[k].log_likelihood, k, d, n), k))
    return mixture.memberships(rows, "node_id", "v", models[best]).filter(F.col("p") > threshold)


def global_local_clusters(vectors: DataFrame, threshold: float = SOFT, **options) -> DataFrame:
    """(node_id, cluster): global soft clusters, those of more than four nodes clustered again; numbered anew."""
    first = soft_clusters(vectors, threshold, **options).persist()
    sizes = {r["cluster"]: r["n"] for r in first.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    mine = {c: first.filter(F.col("cluster") == c).select("node_id") for c in sizes}
    split = [c for c in sizes if sizes[c] > 4 and len(sizes) > 1]
    # A cluster is fitted by few tasks: several are fitted at the same time.
    with ThreadPoolExecutor(FITS) as pool:
        local = dict(zip(split, pool.map(lambda c: soft_clusters(vectors.join(mine[c], "node_id", "left_semi"), threshold, **options), split)))
    parts, base = [], 0
    for c in sorted(sizes):
        if c not in local:
            parts.append(mine[c].select("node_id", F.lit(base).alias("cluster")))
            base += 1
        else:
            parts.append(local[c].select("node_id", (F.col("cluster") + base).alias("cluster")))
            base += MAX_K
    return reduce(DataFrame.unionByName, parts) if parts else vectors.select("node_id", F.lit(0).alias("cluster"))


def soft_rate(memberships: DataFrame) -> DataFrame:
    """Share of nodes in more than one cluster."""
    per = memberships.groupBy("node_id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.avg((F.col("n") > 1).cast("double")), F.lit(0.0)).alias("rate"))


def leaves_of(corpus: DataFrame, size: int = 100) -> DataFrame:
    made = lexical.chunks(corpus, size, 0)
    return made.select(F.concat(F.col("doc_id").cast("string"), F.lit("::l0::"), F.col("chunk_idx").cast("string")).alias("node_id"), F.lit(0).alias("level"), "doc_id", "text")


def build(corpus: DataFrame, encoder: Encoder = hash_encoder, summarize: Callable = T.summary_by_frequency, max_levels: int = MAX_LEVELS, min_nodes: int = MIN_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the summary tree over the corpus. A summary is made of its members' whole texts."""
    level = encoder(leaves_of(corpus)).checkpoint(eager=True)
    nodes, edges = [level], []
    count = level.count()
    for depth in range(1, max_levels + 1):
        if count <= min_nodes:
            break
        member = global_local_clusters(level.select("node_id", "emb")).checkpoint(eager=True)
        if member.select("cluster").distinct().count() <= 1:
            break
        grouped = member.join(level.select("node_id", "text"), "node_id").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("t"))
        joined = F.array_join(T.words(F.array_join(F.transform("t", lambda x: x["text"]), " ")), " ")
        made = grouped.select("cluster", F.lit(depth).alias("level"), F.transform("t", lambda x: x["node_id"]).alias("children"), summarize(joined).alias("text"))
        # Nodes and edges both read the summaries: they are made once.
        made = made.withColumn("node_id", T.node_id(F.col("level"), F.col("cluster"), F.col("text"))).checkpoint(eager=True)
        doc_type = level.schema["doc_id"].dataType
        parents = encoder(made.select("node_id", "level", F.lit(None).cast(doc_type).alias("doc_id"), "text")).checkpoint(eager=True)
        edges.append(made.select(F.col("node_id").alias("parent_id"), F.explode("children").alias("child_id")).distinct().checkpoint(eager=True))
        nodes.append(parents)
        if parents.count() >= count:
            break
        level, count = parents, parents.count()
    spark = corpus.sparkSession
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges) if edges else spark.createDataFrame([], "parent_id string, child_id string")


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")


def paths_to_root(edges: DataFrame, starts: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(start, node_id, step): every node on the ways up from each start (step 0), one join a level."""
    frontier = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("step"))
    out = [frontier]
    up = edges.select(F.col("child_id").alias("node_id"), "parent_id")
    for step in range(1, max_levels + 1):
        frontier = frontier.join(up, "node_id").select("start", F.col("parent_id").alias("node_id"), F.lit(step).alias("step")).distinct()
        out.append(frontier)
    return reduce(DataFrame.unionByName, out)


def to_documents(scores: DataFrame, nodes: DataFrame, edges: DataFrame | None, k: int, node_to_doc: str = "leaf_only", max_levels: int = MAX_LEVELS) -> DataFrame:
    """Node scores (query_id, node_id, score) as a document run. leaf_only drops summaries; expand gives a summary's
    score to the documents below it."""
    own = scores.join(nodes.filter("doc_id is not null").select("node_id", "doc_id"), "node_id").select("query_id", "doc_id", "score")
    if node_to_doc == "expand" and edges is not None:
        ways = paths_to_root(edges, nodes.filter("doc_id is not null"), max_levels).filter("step > 0").join(nodes.select(F.col("node_id").alias("start"), "doc_id"), "start").select("node_id", "doc_id").distinct()
        own = own.unionByName(scores.join(ways, "node_id").select("query_id", "doc_id", "score"))
    return ranked(max_pool(own), k)


def node_scores(nodes: DataFrame, queries: DataFrame, k: int, encoder: Encoder = hash_encoder) -> DataFrame:
    got = block_scores(nodes.select(F.col("node_id").alias("doc_id"), "emb"), encoder(queries), k)
    return got.withColumnRenamed("doc_id", "node_id")


def collapsed(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, encoder: Encoder = hash_encoder, node_to_doc: str = "leaf_only") -> DataFrame:
    """All nodes scored at once. With leaf_only summaries are dropped before the cut, so they take no places."""
    pool = nodes.filter("doc_id is not null") if node_to_doc == "leaf_only" else nodes
    # Several chunks of one document may lead: over-fetch nodes per document, exactly, by scoring documents.
    if node_to_doc == "leaf_only":
        return ranked(block_scores(pool.select("doc_id", "emb"), encoder(queries), k), k)
    return to_documents(node_scores(pool, queries, 10 * k, encoder), nodes, edges, k, node_to_doc)


def traversal(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, encoder: Encoder = hash_encoder, node_to_doc: str = "leaf_only", scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """From the top level down: at each level the k best of the frontier are kept and their children searched next.
    A child of several parents is searched once."""
    from .fusion import dot

    q = encoder(queries).select("query_id", F.col("emb").alias("q"))
    top = nodes.agg(F.max("level").alias("m")).first()["m"] or 0
    frontier = nodes.filter(F.col("level") == top).select("node_id").crossJoin(F.broadcast(queries.select("query_id")))  # roots are few
    kept = []
    for _ in range(top + 1):
        scored = scorer(frontier, nodes) if scorer else frontier.join(nodes.select("node_id", "emb"), "node_id").join(q, "query_id").select("query_id", F.col("node_id").alias("doc_id"), dot(F.col("emb"), F.col("q")).alias("score"))
        best = ranked(scored, k).select("query_id", F.col("doc_id").alias("node_id"), "score")
        kept.append(best)
        frontier = best.join(edges.select(F.col("parent_id").alias("node_id"), "child_id"), "node_id").select("query_id", F.col("child_id").alias("node_id")).distinct()
    every = reduce(DataFrame.unionByName, kept).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return to_documents(every, nodes, edges, k, node_to_doc)


def late_scores(node_tokens: DataFrame, query_tokens: DataFrame, k: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score) by MaxSim over the nodes' token vectors: of all nodes (the best k), or of pairs."""
    pairs = None if pairs is None else pairs.select("query_id", F.col("node_id").alias("doc_id"))
    return maxsim_scores(node_tokens.withColumnRenamed("node_id", "doc_id"), query_tokens, pairs, k).withColumnRenamed("doc_id", "node_id")


def best_nodes(scores: DataFrame, k: int) -> DataFrame:
    """The k best nodes of each query (ties: the smaller id)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scores.withColumn("score", F.round("score", 6)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def late_collapsed(nodes: DataFrame, edges: DataFrame, node_tokens: DataFrame, query_tokens: DataFrame, k: int = 10, node_to_doc: str = "expand") -> DataFrame:
    """All nodes of the tree, summaries too, ranked by MaxSim; the k best become documents (a summary: those below it,
    or with leaf_only none)."""
    return to_documents(best_nodes(late_scores(node_tokens, query_tokens, k), k), nodes, edges, k, node_to_doc)


def late_traversal(nodes: DataFrame, edges: DataFrame, node_tokens: DataFrame, query_tokens: DataFrame, k: int = 10, node_to_doc: str = "expand") -> DataFrame:
    """From the top level down: the frontier's nodes are ranked by MaxSim, the k best kept, and their children searched
    next; of all kept ones the k best become documents."""
    top = nodes.agg(F.max("level").alias("m")).first()["m"] or 0
    queries = query_tokens.select("query_id").distinct()
    frontier = nodes.filter(F.col("level") == top).select("node_id").crossJoin(F.broadcast(queries))  # roots are few
    kept = []
    for _ in range(top + 1):
        best = best_nodes(late_scores(node_tokens, query_tokens, k, frontier), k)
        kept.append(best)
        frontier = best.join(edges.select(F.col("parent_id").alias("node_id"), "child_id"), "node_id").select("query_id", F.col("child_id").alias("node_id")).distinct()
    every = reduce(DataFrame.unionByName, kept).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return to_documents(best_nodes(every, k), nodes, edges, k, node_to_doc)

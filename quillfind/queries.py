"""The registered queries over the test tables: name -> function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import agentic, dense, evaluate, fusion, graph, late, lexical, sampling, sparse, tree
from .plans import pipelines
from .sources import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return datasets.load_tables(spark, sf)


def _run(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb"), "label")


def _tokens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of eight vectors each, queries (all whose id is divisible by 50, with all their vectors), and sixteen
    centroids."""
    v = _vectors(spark, sf)
    docs = v.select(F.floor(F.col("vec_id") / 8).alias("doc_id"), (F.col("vec_id") % 8).cast("int").alias("tok_idx"), "emb")
    queries = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "tok_idx", "emb")
    cents = v.filter("vec_id < 16").select(F.col("vec_id").cast("int").alias("centroid_id"), F.col("emb").alias("vec"))
    return docs, queries, cents


# --- text ---------------------------------------------------------------------------------------------------------


@query
def full_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.md5(T.full_text(F.col("p_name"), F.col("p_type"))).alias("full_md5"))


@query
def titled_pages(spark, sf):
    return datasets.titled_pages(table(spark, sf, "pages")).select("doc_id", "title", F.md5("text").alias("text_md5"))


@query
def chunk_200_50(spark, sf):
    c, _, _ = _inputs(spark, sf)
    return lexical.chunks(c).select("doc_id", "chunk_idx", F.md5("text").alias("chunk_md5"), F.size(T.words(F.col("text"))).alias("n_words"))


@query
def chunk_100_0(spark, sf):
    c, _, _ = _inputs(spark, sf)
    return lexical.chunks(c, 100, 0).select("doc_id", "chunk_idx", F.concat(F.col("doc_id").cast("string"), F.lit("::l0::"), F.col("chunk_idx").cast("string")).alias("chunk_id"), F.md5("text").alias("chunk_md5"))


@query
def contextual_chunks(spark, sf):
    c, _, _ = _inputs(spark, sf)
    return lexical.chunks(c, contextual=True).select("doc_id", "chunk_idx", F.md5("text").alias("chunk_md5"), F.size(T.words(F.col("context"))).alias("context_words"))


@query
def contextual_chunks_titled(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("text"))
    return lexical.chunks(p, contextual=True).select("doc_id", "chunk_idx", "text")


@query
def tokenize_stem(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query
def term_df(spark, sf):
    c, _, _ = _inputs(spark, sf)
    return lexical.Index(c).df


@query
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query
def extractive_summary_a(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.summary_by_position(F.col("text"))).alias("summary_md5"))


@query
def extractive_summary_b(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.summary_by_frequency(F.col("text"))).alias("summary_md5"))


@query
def hyde_template(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.hypothetical_document(F.col("text")).alias("hypothetical"))


@query
def decompose_query(spark, sf):
    q = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.decompose_query(F.col("text")).alias("parts"))
    return q.select("conv_id", "turn", F.size("parts").alias("n"), F.array_join("parts", " | ").alias("parts"))


@query
def decompose_rules(spark, sf):
    rows = [(1, "cats and dogs?"), (2, "difference between a and b"), (3, "compare x to y"), (4, "tell me who wrote the book that won"), (5, "say what it is which shines"), (6, "A AND B"), (7, "a and b and c"), (8, "plain")]
    q = spark.createDataFrame(rows, "id int, text string")
    return q.select("id", F.array_join(T.decompose_query(F.col("text")), " | ").alias("parts"))


@query
def reformulate_query(spark, sf):
    q = table(spark, sf, "conversations").filter("role = 'user'")
    return q.select("conv_id", "turn", T.broaden(F.col("text")).alias("broader"), T.strip_question(F.concat(F.lit("What is "), "text")).alias("specific"))


@query
def keyword_coverage(spark, sf):
    """Each query's keywords against the document with its own id."""
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    return b.join(d, "item_id", "left").select("item_id", F.round(T.keyword_coverage(F.col("text"), F.col("context")), 6).alias("coverage"))


@query
def node_ids(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.node_id(F.lit(1), F.col("item_id") % 5, F.col("text")).alias("node_id"))


# --- lexical ------------------------------------------------------------------------------------------------------


@query
def bm25_topk(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(lexical.bm25(lexical.Index(c), q, 10))


@query
def bm25_idf(spark, sf):
    c, _, _ = _inputs(spark, sf)
    return lexical.Index(c).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_zero_fill(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(lexical.bm25(lexical.Index(c), q, 30, c))


@query
def bm25_prf(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(lexical.bm25_prf(lexical.Index(c), q, 10))


@query
def contextual_bm25(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(lexical.bm25(lexical.Index(c, contextual=True), q, 10))


# --- dense, sparse, fusion ----------------------------------------------------------------------------------------


@query
def dense_precomputed_topk(spark, sf):
    v = _vectors(spark, sf)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "emb")
    return _run(fusion.ranked(dense.block_scores(v.select(F.col("vec_id").alias("doc_id"), "emb"), q, 10, 5), 10, 5))


@query
def l2_normalize(spark, sf):
    v = _vectors(spark, sf).withColumn("s", F.transform("emb", lambda x: x.cast("double") * 3))
    n = fusion.l2_normalize(F.col("s"))
    return v.select("vec_id", F.round(fusion.dot(n, n), 6).alias("norm"), F.round(n[0], 6).alias("first"))


@query
def hash_encode(spark, sf):
    e = dense.hash_encoder(table(spark, sf, "benchmark"))
    return e.select("item_id", F.posexplode("emb").alias("dim", "x")).filter("x <> 0").select("item_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query
def naive_dense(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(dense.dense(lexical.chunks(c), q))


@query
def hyde(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(dense.hyde(lexical.chunks(c), q))


@query
def contextual_dense(spark, sf):
    c, q, _ = _inputs(spark, sf)
    return _run(dense.dense(lexical.chunks(c, contextual=True), q))


def _pipeline(name: str):
    def f(spark, sf):
        c, q, _ = _inputs(spark, sf)
        return _run(pipelines.REGISTRY[name](pipelines.Context(c), q))

    f.__name__ = name
    return query(f)


for _name in ("hybrid_rag", "contextual_hybrid", "splade", "splade_hybrid", "late_chunking", "late_interaction", "late_interaction_approx", "raptor_single_vector", "raptor_late_collapsed", "raptor_late_traversal", "two_stage_dense", "agentic_multihop", "reflection", "graph"):
    _pipeline(_name)


@query
def expansion_terms(spark, sf):
    w = sparse.log_tf_encoder(table(spark, sf, "benchmark"), ["item_id"])
    return sparse.expansion_terms(w, ["item_id"], 5).select("item_id", "term", "weight", F.col("rank").cast("int").alias("rank"))


@query
def max_pool(spark, sf):
    v = _vectors(spark, sf).select((F.col("vec_id") % 7).alias("query_id"), F.floor(F.col("vec_id") / 8).alias("doc_id"), F.col("emb")[0].cast("double").alias("score"))
    return fusion.max_pool(v).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query
def rrf(spark, sf):
    v = _vectors(spark, sf).select((F.col("vec_id") % 5).alias("query_id"), F.floor(F.col("vec_id") / 5).alias("doc_id"), F.col("emb")[0].cast("double").alias("a"), F.col("emb")[1].cast("double").alias("b"))
    r = [fusion.ranked(v.select("query_id", "doc_id", F.col(c).alias("score")), 20) for c in ("a", "b")]
    return _run(fusion.ranked(fusion.reciprocal_rank_fusion(r), 10))


# --- late interaction ---------------------------------------------------------------------------------------------


@query
def maxsim_topk(spark, sf):
    d, q, _ = _tokens(spark, sf)
    return _run(fusion.ranked(late.maxsim_scores(d, q, k=10, digits=5), 10, 5))


@query
def maxsim_masked(spark, sf):
    d, q, _ = _tokens(spark, sf)
    return _run(fusion.ranked(late.maxsim_scores(d.withColumn("mask", (F.col("tok_idx") % 2).cast("int")), q, k=10, digits=5), 10, 5))


def _pooled(how: str):
    def f(spark, sf):
        d, _, _ = _tokens(spark, sf)
        return late.pool(d, ["doc_id"], how).select("doc_id", F.posexplode("emb").alias("dim", "x")).select("doc_id", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))

    f.__name__ = f"pool_{how}"
    return query(f)


for _how in ("mean", "max", "cls"):
    _pooled(_how)


@query
def late_chunking_pool(spark, sf):
    v = _vectors(spark, sf).select(F.floor(F.col("vec_id") / 50).alias("doc_id"), (F.col("vec_id") % 50).cast("int").alias("tok_idx"), "emb")
    return late.late_chunks(v, 16).select("doc_id", "chunk_idx", F.posexplode("emb").alias("dim", "x")).select("doc_id", "chunk_idx", "dim", F.round("x", 5).alias("x"))


@query
def assign_centroids(spark, sf):
    d, _, c = _tokens(spark, sf)
    return late.nearest_centroids(d, c, ["doc_id", "tok_idx"], digits=6).select("doc_id", "tok_idx", "centroid_id")


@query
def shared_centroids(spark, sf):
    d, q, c = _tokens(spark, sf)
    return late.shared_centroids(d, q, c, 4)


@query
def approx_maxsim(spark, sf):
    d, q, c = _tokens(spark, sf)
    return _run(late.approximate_maxsim(d, q, c, 3, 0.1, 2))


@query
def fidelity(spark, sf):
    d, q, c = _tokens(spark, sf)
    exact = fusion.ranked(late.maxsim_scores(d, q, k=3), 3)
    return fusion.overlap_at_k(late.approximate_maxsim(d, q, c, 3, 0.1, 2), exact, 3).select("query_id", F.round("fidelity", 6).alias("fidelity"))


@query
def residual_codec_roundtrip(spark, sf):
    d, _, c = _tokens(spark, sf)
    codes, bounds = late.compress(d, c)
    back = late.decompress(codes, bounds, c)
    return back.select("doc_id", "tok_idx", F.round(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query
def compressed_maxsim(spark, sf):
    d, q, c = _tokens(spark, sf)
    return _run(late.compressed_maxsim(*late.compress(d, c), c, q, 5, 2, digits=4))


@query
def kmeans_centroids(spark, sf):
    d, _, _ = _tokens(spark, sf)
    return late.centroid_table(d, 8).select("centroid_id", "vec")


# --- graph and tree -----------------------------------------------------------------------------------------------


def _graph(spark, sf):
    return graph.similarity_graph(_vectors(spark, sf).select(F.col("vec_id").alias("node_id"), "emb"), 0.25, 5)


@query
def sim_graph(spark, sf):
    return _graph(spark, sf).select("src", "dst", F.round("w", 6).alias("w"))


@query
def communities(spark, sf):
    return graph.label_propagation(_vectors(spark, sf).select(F.col("vec_id").alias("node_id")), _graph(spark, sf))


@query
def community_summary(spark, sf):
    d = table(spark, sf, "documents")
    return graph.community_summaries(d.select(F.col("doc_id").alias("node_id"), (F.col("doc_id") % 20).alias("label")), d.select(F.col("doc_id").alias("node_id"), "text")).select("label", "size", F.md5("summary").alias("summary_md5"))


@query
def community_expansion(spark, sf):
    c, q, _ = _inputs(spark, sf)
    labels = c.select("doc_id", (F.col("doc_id") % 97).alias("label"))
    return _run(graph.expand(dense.dense(lexical.chunks(c), q), labels, 10))


def _supplier_tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Regions over nations over suppliers."""
    r, n, s = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(key("r", "n_regionkey").alias("parent_id"), key("n", "n_nationkey").alias("child_id")).unionByName(s.select(key("n", "s_nationkey").alias("parent_id"), key("s", "s_suppkey").alias("child_id")))
    nodes = r.select(key("r", "r_regionkey").alias("node_id"), F.lit(2).alias("level")).unionByName(n.select(key("n", "n_nationkey").alias("node_id"), F.lit(1).alias("level"))).unionByName(s.select(key("s", "s_suppkey").alias("node_id"), F.lit(0).alias("level")))
    return nodes, edges


@query
def tree_leaves(spark, sf):
    return tree.leaf_nodes(*_supplier_tree(spark, sf)).select("node_id", "level")


@query
def tree_paths(spark, sf):
    nodes, edges = _supplier_tree(spark, sf)
    return tree.paths_to_root(edges, nodes.filter("level = 0"), 2)


def _late_tree(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same tree, with suppliers as documents and two vectors for every node; and query tokens."""
    nodes, edges = _supplier_tree(spark, sf)
    number = F.substring("node_id", 2, 20).cast("long")
    nodes = nodes.withColumn("doc_id", F.when(F.col("level") == 0, number))
    first = 2 * number + F.when(F.col("level") == 0, 0).when(F.col("level") == 1, 300).otherwise(400)
    pairs = nodes.select("node_id", F.explode(F.array(first, first + 1)).alias("vec_id"), first.alias("v"))
    tokens = pairs.join(_vectors(spark, sf), "vec_id").select("node_id", (F.col("vec_id") - F.col("v")).cast("int").alias("tok_idx"), "emb")
    return nodes, edges, tokens, _tokens(spark, sf)[1]


@query
def tree_late_collapsed(spark, sf):
    return _run(tree.late_collapsed(*_late_tree(spark, sf)))


@query
def tree_late_traversal(spark, sf):
    return _run(tree.late_traversal(*_late_tree(spark, sf)))


@query
def joined_chunks(spark, sf):
    c, _, _ = _inputs(spark, sf)
    return agentic.joined_texts(lexical.chunks(c, 100, 0)).select("doc_id", F.md5("text").alias("text_md5"))


@query
def sparse_activation(spark, sf):
    v = _vectors(spark, sf).select("vec_id", F.posexplode("emb").alias("dim", "x")).filter("x > 0")
    return v.select("vec_id", "dim", F.round(sparse.activation(F.col("x").cast("double")), 6).alias("weight"))


@query
def soft_membership(spark, sf):
    m = tree.soft_clusters(_vectors(spark, sf).select(F.col("vec_id").alias("node_id"), "emb"))
    return m.select("node_id", "cluster", F.round("p", 6).alias("p"))


# --- evaluation ---------------------------------------------------------------------------------------------------


def _evaluated(spark, sf) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    c, q, rel = _inputs(spark, sf)
    index = lexical.Index(c)
    # Metrics, pairs and correlations read the runs several times.
    return rel, q, {"bm25": lexical.bm25(index, q, 10).persist(), "dense": dense.dense(lexical.chunks(c), q).persist()}


@query
def ir_metrics_per_query(spark, sf):
    rel, _, runs = _evaluated(spark, sf)
    return evaluate.per_query(runs["bm25"], rel, (1, 3, 10)).select("query_id", "metric", "k", F.round("value", 6).alias("value"))


@query
def metrics_summary(spark, sf):
    rel, _, runs = _evaluated(spark, sf)
    parts = [evaluate.summary(evaluate.per_query(r, rel, (1, 3, 5, 10))).select(F.lit(n).alias("pipeline"), "metric", "k", F.round("value", 4).alias("value")) for n, r in runs.items()]
    return parts[0].unionByName(parts[1])


def _diffs(spark, sf) -> DataFrame:
    rel, q, runs = _evaluated(spark, sf)
    every = rel.unionByName(q.select("query_id", F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("rel")))
    parts = [evaluate.aligned(evaluate.per_query(r, rel, (10,)), every).select(F.lit(n).alias("pipeline"), F.lit(i).alias("ord"), "query_id", "value") for i, (n, r) in enumerate(runs.items())]
    return evaluate.pairwise(parts[0].unionByName(parts[1]))


@query
def pairwise_diff(spark, sf):
    return _diffs(spark, sf).select("pipeline_a", "pipeline_b", "query_id", F.round("diff", 5).alias("diff"))


@query
def t_stat(spark, sf):
    return evaluate.t_statistics(_diffs(spark, sf)).select("pipeline_a", "pipeline_b", "n", F.round("mean_diff", 5).alias("mean_diff"), F.round("t", 4).alias("t"))


@query
def bootstrap(spark, sf):
    return evaluate.significance(_diffs(spark, sf), 2000)


@query
def bonferroni(spark, sf):
    p = table(spark, sf, "nation").select(F.col("n_name").alias("pair"), (F.col("n_nationkey") / 1000.0).cast("double").alias("p_value"))
    return evaluate.bonferroni(p).select("pair", F.round("adjusted_alpha", 8).alias("adjusted_alpha"), "significant")


@query
def spearman(spark, sf):
    _, _, runs = _evaluated(spark, sf)
    return evaluate.spearman(runs["bm25"], runs["dense"]).select("query_id", "n", F.round("rho", 6).alias("rho"))


@query
def em_f1(spark, sf):
    """Each item's text against that of the item with the id before its own."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold"))
    before = b.select((F.col("item_id") + 1).alias("item_id"), F.col("gold").alias("predicted"))
    return evaluate.em_f1(b.join(before, "item_id", "left")).select("item_id", "em", F.round("f1", 6).alias("f1"))


@query
def latency_percentiles(spark, sf):
    return evaluate.latency(table(spark, sf, "events"), "value", ["event_type"]).select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "p99")], "n")


# --- sampling and triples -----------------------------------------------------------------------------------------


@query
def subsample_queries(spark, sf):
    _, q, rel = _inputs(spark, sf)
    return sampling.subsample_queries(q, rel, 10)[0].select("query_id")


@query
def subsample_corpus_keep_judged(spark, sf):
    c, _, rel = _inputs(spark, sf)
    return sampling.subsample_corpus(c, rel, 100).select("doc_id")


def _triples(hard: bool):
    def f(spark, sf):
        t = sampling.triples(*_inputs(spark, sf), hard=hard)
        return t.select("query_id", "doc_id", "negative_id", F.md5(F.concat_ws("|", "query", "positive", "negative")).alias("triple_md5"))

    f.__name__ = "triples_hard_negative" if hard else "triples_random_negative"
    return query(f)


_triples(True)
_triples(False)


@query
def benchmark_run(spark, sf):
    """The runner: three pipelines, their metrics in one table."""
    c, q, rel = _inputs(spark, sf)
    b = pipelines.Benchmark(pipelines.Context(c), q, rel).run(["bm25", "naive_dense", "hybrid_rag"])
    return b.metrics().select("pipeline", "metric", "k", "value")

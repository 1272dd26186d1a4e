"""The registry of retrieval pipelines: name -> (context, queries) -> run. Every pipeline answers all queries in one
plan. The context holds what they share (chunks, postings, vectors, the summary tree), each made at its first use."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Experiment
from ..functions import text as T
from ..operators import agentic, dense, evaluate, graph, late, lexical, sparse, tree
from ..operators.fusion import ranked, reciprocal_rank_fusion
from ..schema import spread


class Context:
    """A corpus with settings and plug-ins, and what pipelines share, each made at its first use and kept (in memory,
    else on disk; made again where an executor is lost), so one corpus answers many batches of queries.

    Plug-ins: `encoder(df)` adds `emb` to rows with `text`; `token_encoder(df, key)` gives (key, tok_idx, emb) rows;
    `sparse_encoder(df, keys)` gives (keys, term, weight) rows; `pair_scorer(query, text)` and `generate(query)` are
    column functions; `summarize(text)` makes a parent's text. The built-in token encoder has no position limit and
    encodes whole texts (`config.encoder.max_doc_length` is for neural plug-ins)."""

    def __init__(self, corpus: DataFrame, config: Experiment | None = None, encoder: dense.Encoder | None = None, token_encoder: Callable | None = None, sparse_encoder: Callable = sparse.log_tf_encoder, pair_scorer: Callable = agentic.token_overlap, generate: Callable = T.hypothetical_document, summarize: Callable = T.summary_by_frequency):
        self.corpus, self.config = corpus, config or Experiment()
        self.encoder = encoder or partial(dense.hash_encoder, d=self.config.encoder.projection_dim)
        self.token_encoder = token_encoder or partial(hash_tokens, d=32)
        self.sparse_encoder, self.pair_scorer, self.generate, self.summarize = sparse_encoder, pair_scorer, generate, summarize

    @property
    def k(self) -> int:
        return self.config.retrieval.top_k

    @cached_property
    def chunks(self) -> DataFrame:
        return lexical.chunks(self.corpus, self.config.chunking.chunk_size, self.config.chunking.chunk_overlap).persist()

    @cached_property
    def context_chunks(self) -> DataFrame:
        return lexical.chunks(self.corpus, self.config.chunking.chunk_size, self.config.chunking.chunk_overlap, contextual=True).select("doc_id", "chunk_idx", "text").persist()

    @cached_property
    def vectors(self) -> DataFrame:
        return self.encoder(self.chunks).select("doc_id", "chunk_idx", "emb").persist()

    @cached_property
    def context_vectors(self) -> DataFrame:
        return self.encoder(self.context_chunks).select("doc_id", "chunk_idx", "emb").persist()

    @cached_property
    def index(self) -> lexical.Index:
        return lexical.Index(self.corpus, chunked=self.chunks)

    @cached_property
    def context_index(self) -> lexical.Index:
        return lexical.Index(self.corpus, chunked=self.context_chunks)

    @cached_property
    def postings(self) -> sparse.Postings:
        return sparse.Postings(self.chunks, self.sparse_encoder)

    @cached_property
    def doc_tokens(self) -> DataFrame:
        whole = spread(self.corpus).select("doc_id", T.full_text(F.col("title"), F.col("text")).alias("text"))
        return self.token_encoder(whole, "doc_id").persist()

    @cached_property
    def late_vectors(self) -> DataFrame:
        return late.late_chunks(self.doc_tokens, 128).persist()

    @cached_property
    def centroids(self) -> DataFrame:
        n = self.doc_tokens.count()
        return late.centroid_table(self.doc_tokens, min(256, max(4, n // 10)), self.config.seed)

    @cached_property
    def codes(self) -> tuple[DataFrame, DataFrame]:
        codes, bounds = late.compress(self.doc_tokens, self.centroids)
        return codes.persist(), bounds.persist()

    @cached_property
    def tree(self) -> tuple[DataFrame, DataFrame]:
        return tree.build(self.corpus, self.encoder, self.summarize, max_levels=self.config.clustering.max_levels, min_nodes=self.config.clustering.min_cluster_size)

    @cached_property
    def tree_tokens(self) -> DataFrame:
        """(node_id, tok_idx, emb) of all nodes, summaries too."""
        return self.token_encoder(self.tree[0].select("node_id", "text"), "node_id").persist()

    @cached_property
    def communities(self) -> DataFrame:
        """(doc_id, label): the communities of a document's chunks; a document can be in several."""
        name = F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string"))
        nodes = self.vectors.select(name.alias("node_id"), "doc_id", "emb")
        edges = graph.similarity_graph(nodes.select("node_id", "emb"))
        return graph.label_propagation(nodes, edges).join(nodes.select("node_id", "doc_id"), "node_id").select("doc_id", "label").distinct().persist()

    def made(self, *names: str) -> None:
        """Make the named shared tables now."""
        for name in names:
            got = getattr(self, name)
            for table in got if isinstance(got, tuple) else [got]:
                (table if isinstance(table, DataFrame) else table.tokens).count()


def hash_tokens(df: DataFrame, key: str, d: int = 32, limit: int | None = None) -> DataFrame:
    """(key, tok_idx, emb): each token (of the first `limit`, if given) as the hash encoder's vector of it and its
    neighbours."""
    tokens = T.tokens(F.col("text"))
    t = df.select(key, (tokens if limit is None else F.slice(tokens, 1, limit)).alias("t"))
    near = F.transform("t", lambda x, i: F.concat(F.array(x), F.slice("t", F.greatest(i, F.lit(1)), F.least(i, F.lit(1))), F.slice("t", i + 2, 1)))
    return t.select(key, F.posexplode(near).alias("tok_idx", "n")).select(key, "tok_idx", dense.hash_encode(F.col("n"), d).alias("emb"))


def _top(c: Context, vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    return ranked(dense.block_scores(vectors, queries, k or c.k), k or c.k)


def _dense(c: Context, q: DataFrame, k: int | None = None) -> DataFrame:
    return _top(c, c.vectors, c.encoder(q), k)


def _fused(c: Context, rankings: list[DataFrame]) -> DataFrame:
    return ranked(reciprocal_rank_fusion(rankings, c.config.retrieval.rrf_k), c.k)


def _context_dense(c: Context, q: DataFrame, k: int | None = None) -> DataFrame:
    return _top(c, c.context_vectors, c.encoder(q), k)


def _sparse(c: Context, q: DataFrame, k: int | None = None) -> DataFrame:
    return sparse.search(c.postings, q, k or c.k, c.config.retrieval.idf_reweighting)


def _query_tokens(c: Context, q: DataFrame) -> DataFrame:
    return c.token_encoder(q, "query_id")


def _late_chunking(c: Context, q: DataFrame) -> DataFrame:
    """Queries are pooled from the same encoder's tokens as the documents' chunks are."""
    return _top(c, c.late_vectors, late.pool(_query_tokens(c, q), ["query_id"]))


def _graph(c: Context, q: DataFrame, strategy: str = "hybrid", base: Callable | None = None) -> DataFrame:
    """`standard`: the base retriever alone; `graph` and `hybrid`: with the members of its first documents' communities
    at 0.5 and 0.3. Without a base retriever, nodes' vectors are searched (but `standard` needs one)."""
    if strategy not in graph.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(graph.STRATEGIES)}")
    if strategy == "standard":
        if base is None:
            raise ValueError("the standard strategy needs a base retriever")
        return base(q)
    return graph.expand((base or partial(_dense, c))(q), c.communities, c.k, score=graph.STRATEGIES[strategy])


REGISTRY: dict[str, Callable[[Context, DataFrame], DataFrame]] = {
    "naive_dense": _dense,
    "hybrid_rag": lambda c, q: _fused(c, [lexical.bm25(c.index, q, 3 * c.k, c.corpus), _dense(c, q, 3 * c.k)]),
    "hyde": lambda c, q: _top(c, c.vectors, c.encoder(q.withColumn("text", c.generate(F.col("text"))))),
    "splade": _sparse,
    "splade_hybrid": lambda c, q: _fused(c, [_sparse(c, q, 3 * c.k), _dense(c, q, 3 * c.k)]),
    "bm25": lambda c, q: lexical.bm25(c.index, q, c.k),
    "bm25_prf": lambda c, q: lexical.bm25_prf(c.index, q, c.k, c.config.retrieval.bm25_prf_k, c.config.retrieval.expansion_terms),
    "contextual_dense": _context_dense,
    "contextual_bm25": lambda c, q: lexical.bm25(c.context_index, q, c.k),
    "contextual_hybrid": lambda c, q: _fused(c, [_context_dense(c, q, 3 * c.k), lexical.bm25(c.context_index, q, 3 * c.k, c.corpus)]),
    "late_chunking": _late_chunking,
    "late_interaction": lambda c, q: ranked(late.maxsim_scores(c.doc_tokens, _query_tokens(c, q), k=c.k), c.k),
    "late_interaction_approx": lambda c, q: late.approximate_maxsim(c.doc_tokens, _query_tokens(c, q), c.centroids, c.k, 0.2),
    "late_interaction_compressed": lambda c, q: late.compressed_maxsim(*c.codes, c.centroids, _query_tokens(c, q), c.k),
    "raptor_single_vector": lambda c, q: tree.collapsed(*c.tree, q, c.k, c.encoder, "expand"),
    "raptor_late_collapsed": lambda c, q: tree.late_collapsed(*c.tree, c.tree_tokens, _query_tokens(c, q), c.k),
    "raptor_late_traversal": lambda c, q: tree.late_traversal(*c.tree, c.tree_tokens, _query_tokens(c, q), c.k),
    "two_stage_dense": lambda c, q: agentic.two_stage(q, c.corpus, lambda x: _dense(c, x, c.config.retrieval.first_stage_k), c.k, scorer=c.pair_scorer),
    "agentic_multihop": lambda c, q: agentic.multi_hop(q, lambda x: _dense(c, x), c.k),
    "reflection": lambda c, q: agentic.reflection(q, c.corpus, lambda x: _dense(c, x), c.k),
    "graph": _graph,
}

#: What of the context each pipeline searches: its index, made before its queries are timed.
NEEDS: dict[str, tuple[str, ...]] = {
    "hybrid_rag": ("index", "vectors"), "splade": ("postings",), "splade_hybrid": ("postings", "vectors"), "bm25": ("index",), "bm25_prf": ("index",),
    "contextual_dense": ("context_vectors",), "contextual_bm25": ("context_index",), "contextual_hybrid": ("context_vectors", "context_index"),
    "late_chunking": ("late_vectors",), "late_interaction": ("doc_tokens",), "late_interaction_approx": ("doc_tokens", "centroids"), "late_interaction_compressed": ("codes",),
    "raptor_single_vector": ("tree",), "raptor_late_collapsed": ("tree", "tree_tokens"), "raptor_late_traversal": ("tree", "tree_tokens"), "graph": ("vectors", "communities"),
}

#: Families that a run can leave out.
HEAVY, COLBERT, RAPTOR = {"two_stage_dense", "graph"}, {n for n in REGISTRY if n.startswith("late_interaction")}, {n for n in REGISTRY if n.startswith("raptor")}


def selected(names: Iterable[str], skip_heavy: bool = False, skip_colbert: bool = False, skip_raptor: bool = False) -> list[str]:
    names = list(names)
    if odd := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown pipelines {odd}")
    out = set().union(HEAVY if skip_heavy else set(), COLBERT if skip_colbert else set(), RAPTOR if skip_raptor else set())
    return [n for n in names if n not in out]


class Benchmark:
    """Runs pipelines over one corpus with errors kept apart: runs, timings, errors; then metrics and significance. A
    pipeline's index time is that of the shared tables it needs and none before it made."""

    def __init__(self, context: Context, queries: DataFrame, qrels: DataFrame):
        self.context, self.queries, self.qrels = context, queries, qrels
        self.runs: dict[str, DataFrame] = {}
        self.timings: list[dict] = []
        self.errors: dict[str, str] = {}

    def run(self, names: Iterable[str]) -> Benchmark:
        n = self.queries.count()
        for name in selected(names):
            began = time.perf_counter()
            try:
                self.context.made(*NEEDS.get(name, ("vectors",)))
                indexed = time.perf_counter()
                plan = REGISTRY[name](self.context, self.queries)
                self.runs[name] = plan.select("query_id", "doc_id", "score", "rank").checkpoint(eager=True)
            except Exception as e:  # one pipeline's failure must not end the others
                self.errors[name] = f"{type(e).__name__}: {e}"
                continue
            done = time.perf_counter()
            self.timings.append({"pipeline": name, "index_s": indexed - began, "query_s": done - indexed, "total_s": done - began, "per_query_ms": 1000 * (done - indexed) / n if n else None})
        if not self.runs and self.errors:
            raise RuntimeError(f"every pipeline failed: {self.errors}")
        return self

    def per_query(self) -> DataFrame:
        out = None
        for name, run in self.runs.items():
            got = evaluate.per_query(run, self.qrels, self.context.config.evaluation.k_values).withColumn("pipeline", F.lit(name))
            out = got if out is None else out.unionByName(got)
        return out

    def metrics(self) -> DataFrame:
        return self.per_query().groupBy("pipeline", "metric", "k").agg(F.round(F.avg("value"), 5).alias("value"))

    def significance(self, metric: str = "ndcg", k: int = 10) -> DataFrame:
        out = None
        for i, (name, run) in enumerate(self.runs.items()):
            got = evaluate.aligned(evaluate.per_query(run, self.qrels, (k,)), self.qrels, metric, k).select(F.lit(name).alias("pipeline"), F.lit(i).alias("ord"), "query_id", "value")
            out = got if out is None else out.unionByName(got)
        e = self.context.config.evaluation
        return evaluate.significance(evaluate.pairwise(out), e.n_resamples, self.context.config.seed, e.alpha)

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillfind.operators import lexical
from quillfind.sources.datasets import containment_qrels


@pytest.mark.parametrize("scores, pool", [(4_000_000, 2_000_000), (6, 3)])
def test_a_tasks_best_are_the_overall_best(spark, monkeypatch, scores, pool):
    """Small products and pools, and a document in several batches, give plain BM25; no pair of a query and a chunk is
    shuffled."""
    monkeypatch.setattr(lexical, "SCORES", scores)
    monkeypatch.setattr(lexical, "POOL", pool)
    text = {d: " ".join(f"w{chr(97 + (d * i) % 7)}x" for i in range(1, 6 + d)) for d in range(1, 13)}
    corpus = spark.createDataFrame([(d, "", t) for d, t in text.items()], "doc_id long, title string, text string").repartition(3)
    index = lexical.Index(corpus, 4, 1)
    q = spark.createDataFrame([("a", "wax wbx wbx"), ("b", "wcx"), ("c", "none")], "query_id string, text string")
    chunks = {(r["doc_id"], r["chunk_idx"]): Counter(r["tokens"]) for r in index.tokens.collect()}
    n, avg = len(chunks), sum(c.total() for c in chunks.values()) / len(chunks)
    df = Counter(t for c in chunks.values() for t in c)
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    got = lexical.bm25(index, q, 3)
    want = []
    for name, terms in (("a", {"wax": 1, "wbx": 2}), ("b", {"wcx": 1})):
        best = {}
        for (d, _), c in chunks.items():
            if any(t in c for t in terms):
                s = sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / avg)) for t, m in terms.items() if t in c)
                best[d] = max(best.get(d, -9e9), s)
        want += [(name, d, pytest.approx(best[d], abs=1e-6)) for d in sorted(best, key=lambda d: (-round(best[d], 6), d))[:3]]
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in got.orderBy("query_id", "rank").collect()] == want
    assert lexical.best_chunks(index, lexical.query_terms(q), 2).count() <= 2 * 2 * index.tokens.rdd.getNumPartitions()


def test_contained_queries_of_any_shape(spark):
    docs = spark.createDataFrame([(1, "xalpha beta　gamma deltay"), (2, "beta"), (3, None), (4, "alpha  beta gamma delta"), (5, "")], "doc_id long, text string")
    queries = spark.createDataFrame([("inner", "alpha beta　gamma delta"), ("two", "a beta"), ("one", "bet"), ("none", ""), ("blank", " "), ("spaces", "alpha  beta gamma")], "query_id string, text string")
    got = {(r["query_id"], r["doc_id"]) for r in containment_qrels(docs, queries).collect()}
    plain = {(q["query_id"], d["doc_id"]) for q in queries.collect() for d in docs.collect() if q["text"] and d["text"] and q["text"] in d["text"]}
    assert got == plain and ("inner", 1) in got and ("one", 2) in got
    assert containment_qrels(docs, queries, 5).filter(F.col("rel") == 1).count() == len(plain)

"""Ablations: how a result changes when one setting does, or one pipeline is put in another's place."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.fusion import ranked
from ..sources import datasets
from .pipelines import REGISTRY, Context

#: The rows of an ablation table: a flat baseline, then one addition after the other.
STEPS = {
    "naive_rag": "naive_dense",
    "hybrid_rag": "hybrid_rag",
    "late_interaction_flat": "late_interaction",
    "raptor_single_vector": "raptor_single_vector",
    "raptor_late_collapsed": "raptor_late_collapsed",
    "raptor_late_traversal": "raptor_late_traversal",
}


class Ablation:
    """Runs steps over one corpus, or any retriever (a function from queries to a run), and compares them per query."""

    def __init__(self, context: Context, queries: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 100)):
        self.context, self.queries, self.qrels, self.ks = context, queries, qrels, ks
        self.runs: dict[str, DataFrame] = {}

    def run_retriever(self, name: str, retrieve: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
        run = ranked(retrieve(self.queries).select("query_id", "doc_id", "score"), k)
        self.runs[name] = run.checkpoint(eager=True)
        return self.runs[name]

    def run(self, steps: Iterable[str] = tuple(STEPS)) -> Ablation:
        for step in steps:
            if step not in STEPS:
                raise ValueError(f"unknown step {step!r}; there are {list(STEPS)}")
            self.run_retriever(step, lambda q, name=STEPS[step]: REGISTRY[name](self.context, q), self.context.k)
        return self

    def metrics(self) -> DataFrame:
        """pipeline, metric, k, value: means over the judged queries."""
        return _union(evaluate.summary(evaluate.per_query(run, self.qrels, self.ks)).withColumn("pipeline", F.lit(name)) for name, run in self.runs.items())

    def per_query(self, metric: str = "ndcg", k: int = 10) -> DataFrame:
        """pipeline, query_id, value: one row for every judged query, 0 where nothing was found."""
        return _union(evaluate.aligned(evaluate.per_query(run, self.qrels, (k,)), self.qrels, metric, k).select(F.lit(name).alias("pipeline"), "query_id", "value") for name, run in self.runs.items())

    def save(self, folder: str) -> None:
        """metrics.json and per_query.json: small tables, one value per step, metric and query."""
        spark: SparkSession = self.qrels.sparkSession
        scores: dict[str, dict[str, float]] = {}
        for r in self.metrics().collect():
            scores.setdefault(r["pipeline"], {})[f"{r['metric']}@{r['k']}"] = r["value"]
        queries: dict[str, dict[str, float]] = {}
        for r in self.per_query().collect():
            queries.setdefault(r["pipeline"], {})[str(r["query_id"])] = r["value"]
        datasets.save_json(spark, scores, f"{folder.rstrip('/')}/metrics.json")
        datasets.save_json(spark, queries, f"{folder.rstrip('/')}/per_query.json")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing has been run")
    return out

"""Connected components of an undirected graph: a spanning forest per partition, then alternating large-star and
small-star steps over what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, join_hot

#: Edges that one task contracts together.
TASK_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges and the smallest node of each one's component: roots are hooked to smaller ones
    and paths halved until every edge lies within one tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def _contracted(edges: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """Edges (a, b), b the smaller, that join the same nodes as the n edges do, at most one per node and partition; and
    whether they are the final labels, since one partition held them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if parts:
            node, root = roots(*(np.concatenate(p) for p in zip(*parts)))
            for x in range(0, len(node), 1 << 16):
                keep = node[x : x + (1 << 16)] != root[x : x + (1 << 16)]
                yield pa.record_batch([pa.array(node[x : x + (1 << 16)][keep]), pa.array(root[x : x + (1 << 16)][keep])], ["a", "b"])

    parts = max(1, -(-n // TASK_EDGES))
    return edges.coalesce(parts).mapInArrow(run, "a long, b long"), parts == 1


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of `edges` (columns a, b, any order, repeats and loops allowed); label is the
    component's smallest node. Every task first contracts its edges, at most about TASK_EDGES of them, to a forest;
    edges that fit one task are done then. Each step groups edges by one end with a minimum, which is pre-aggregated,
    and joins it back (a node with very many edges by a broadcast of its one row); the number of edges never grows.
    Steps go on until nothing changes, which they reach for every graph. Nothing is collected but a count and a checksum
    a step. No edges: no rows."""
    e = checkpointed(edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    e, done = _contracted(e, e.count())
    e = checkpointed(e)
    state, now = None, None if done else _state(e)
    while now != state:
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.filter("b > a"), low, "a", "n", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        e = checkpointed(small)
        now = _state(e)
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

"""Similarity graph, communities by label propagation, and retrieval that expands to community members."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import SCORES, vectors_of
from .fusion import l2_normalize, ranked
from .late import centroid_table, nearest_centroids

#: Nodes of a block at most, and blocks that many cores need where nodes are few; nodes of a block worth a task.
BLOCK, PARALLEL, LEAST = 16_384, 8, 1024
#: Candidates of a row beyond which the whole row is sorted.
MANY = 256
#: Labels that are sent to all tasks at once.
LABELS = 1_000_000
#: Nodes of an index cell on average, and cells that a node is searched for in.
CELL, PROBE = 1024, 12
#: Scores of community members by strategy.
STRATEGIES = {"standard": None, "graph": 0.5, "hybrid": 0.3}


def nearest_rows(a: np.ndarray, b: np.ndarray, take: int, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, w): the `take` rows of b with the greatest product, rounded to six digits (ties: the first),
    for each row of a, without products below `least`. `own` is the place in b of each row of a that is itself in b.
    Rough products (single precision) are made in slices; what cannot be among the best is dropped by the best of a few
    runs of columns, and only the rest is multiplied exactly."""
    parts, rough_a, rough_b = [], a.astype(np.float32), b.astype(np.float32).T.copy()
    step, runs = max(1, SCORES // max(len(b), 1)), 8 * take
    # Single precision and rounding: an entry this far below the last of the best is not among them.
    slack = np.float32(1e-5)
    for at in range(0, len(a), step):
        s = rough_a[at : at + step] @ rough_b
        rows = np.arange(len(s))
        if own is not None:
            inside = own[at : at + step] >= 0
            s[rows[inside], own[at : at + step][inside]] = -np.inf
        if len(b) > 2 * runs:
            best = np.maximum.reduceat(s, np.arange(0, len(b), -(-len(b) // runs)), axis=1)
            floor = np.partition(best, best.shape[1] - take, axis=1)[:, best.shape[1] - take] - slack
        else:
            floor = np.full(len(s), -np.inf, np.float32)
        floor = np.maximum(floor, np.float32(least) - slack)
        x, y = np.divmod(np.flatnonzero(s >= floor[:, None]), len(b))
        many = np.bincount(x, minlength=len(s)) > MANY
        if many.any():
            x, y = x[~many[x]], y[~many[x]]
        w = np.einsum("ij,ij->i", a[at + x], b[y]).round(6)
        order = np.lexsort((y, -w, x))
        x, y, w = x[order], y[order], w[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        keep = (place < take) & (w >= least)
        parts.append((at + x[keep], y[keep], w[keep]))
        # Rows that have very many equals are sorted whole.
        for r in rows[many]:
            w = (b @ a[at + r]).round(6)
            if own is not None and own[at + r] >= 0:
                w[own[at + r]] = -np.inf
            top = np.argsort(-w, kind="stable")[:take]
            top = top[w[top] >= least]
            parts.append((np.full(len(top), at + r), top, w[top]))
    return tuple(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, int) for n in range(3))


def similarity_graph(vectors: DataFrame, threshold: float = 0.5, neighbours: int = 5, block: int = BLOCK) -> DataFrame:
    """(src, dst, w) with src < dst: each node's nearest `neighbours` by cosine that reach the threshold. Nodes are cut
    into blocks by hash; every pair of blocks is one task, which gives back at most `neighbours` rows a node, so memory
    per task and rows are bounded and no pair is a row of its own. All pairs are compared, so time grows with the square
    of the nodes; vectors are sent as they come, once for each block."""
    v = vectors.select("node_id", "emb")
    n = v.count()
    blocks = max(1, -(-n // block), min(PARALLEL, -(-n // LEAST)))
    kind = v.schema["node_id"].dataType
    dealt = v.withColumn("mine", F.pmod(F.xxhash64("node_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    # Pairs of blocks are numbered row by row of the upper triangle: one partition each.
    dealt = dealt.select("node_id", "emb", "mine", (low * blocks - (low * (low - 1) / 2).cast("int") + high - low).cast("int").alias("pair"))
    pairs, names = blocks * (blocks + 1) // 2, ["src", "dst", "w"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        every = pa.Table.from_batches(got).combine_chunks()
        every = every.take(pc.sort_indices(every, sort_keys=[("pair", "ascending"), ("mine", "ascending"), ("node_id", "ascending")]))
        pair, mine, ids = every["pair"].to_numpy(), every["mine"].to_numpy(), every["node_id"].combine_chunks()
        for p in np.unique(pair):
            at, end = np.searchsorted(pair, [p, p + 1])
            m = vectors_of(every["emb"].slice(at, end - at))
            m = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-8)
            cut = int(np.searchsorted(mine[at:end], mine[at], "right"))
            if cut == len(m):
                # One block: a pair with itself, or one whose other block is empty.
                sides = [(0, cut, 0, cut)] if int(p) in own_pairs else []
            else:
                sides = [(0, cut, cut, len(m)), (cut, len(m), 0, cut)]
            for a0, a1, b0, b1 in sides:
                x, y, w = nearest_rows(m[a0:a1], m[b0:b1], neighbours, threshold, np.arange(a1 - a0) if a0 == b0 else None)
                for part in range(0, len(x), 1 << 16):
                    cutout = slice(part, part + (1 << 16))
                    yield pa.record_batch([ids.take(pa.array(at + a0 + x[cutout])), ids.take(pa.array(at + b0 + y[cutout])), pa.array(w[cutout])], names)

    own_pairs = {i * blocks - i * (i - 1) // 2 for i in range(blocks)}
    found = dealt.repartitionById(pairs, "pair").mapInArrow(nearest, f"src {kind.simpleString()}, dst {kind.simpleString()}, w double")
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    kept = found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= neighbours)
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").distinct()


def indexed_graph(vectors: DataFrame, threshold: float = 0.5, neighbours: int = 5, cell: int = CELL, probe: int = PROBE, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The similarity graph by an index, for tables whose square is too much. Every node lies in the cell of its nearest
    centroid (about `cell` nodes each, unit vectors) and is compared with the members of its `probe` nearest cells, so a
    pair in other cells is missed; `tests/test_models.py` measures the recall against `similarity_graph`. Centroids
    are fitted on about late.FIT_TOKENS rows; every row is indexed and searched for. A cell's members and searchers are
    dealt to blocks, so no task holds more than two blocks however full a cell is."""
    kind = vectors.schema["node_id"].dataType.simpleString()
    v = vectors.select(F.col("node_id"), l2_normalize(F.col("emb").cast("array<double>")).alias("emb")).persist()
    n = v.count()
    if n <= cell * probe:
        return similarity_graph(vectors, threshold, neighbours, block)
    centroids = centroid_table(v, -(-n // cell), seed)
    near = nearest_centroids(v, centroids, ["node_id"], probe).select("node_id", "emb", "rank", F.col("centroid_id").alias("c"))
    # How full cells are is known beforehand: a few numbers per cell.
    full = near.groupBy("c").agg(F.sum((F.col("rank") == 1).cast("long")).alias("members"), F.count("*").alias("searchers"))
    full = full.select("c", F.greatest(F.ceil(F.col("members") / block), F.lit(1)).cast("int").alias("mb"), F.ceil(F.col("searchers") / block).cast("int").alias("sb")).persist()
    dealt = near.join(full, "c")
    mine = lambda parts: F.pmod(F.xxhash64("node_id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    members = dealt.filter("rank = 1").withColumn("i", mine("mb")).withColumn("j", every("sb")).select("c", "i", "j", "node_id", "emb", F.lit(0).alias("side"))
    searchers = dealt.withColumn("j", mine("sb")).withColumn("i", every("mb")).select("c", "i", "j", "node_id", "emb", F.lit(1).alias("side"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node_id")
        a, b = (group[group["side"] == side] for side in (1, 0))
        if not len(a) or not len(b):
            return pd.DataFrame({"src": group["node_id"].iloc[:0], "dst": group["node_id"].iloc[:0], "w": np.zeros(0)})
        ids, others = a["node_id"].to_numpy(), b["node_id"].to_numpy()
        s = (np.stack(a["emb"].to_numpy()) @ np.stack(b["emb"].to_numpy()).T).round(6)
        s[ids[:, None] == others[None]] = -np.inf
        take = min(neighbours, len(others))
        top = np.argsort(-s, axis=1, kind="stable")[:, :take]
        got = pd.DataFrame({"src": np.repeat(ids, take), "dst": others[top.ravel()], "w": np.take_along_axis(s, top, axis=1).ravel()})
        return got[got["w"] >= threshold]

    found = members.unionByName(searchers).groupBy("c", "i", "j").applyInPandas(nearest, f"src {kind}, dst {kind}, w double")
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    kept = found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= neighbours)
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").distinct()


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node_id, label): every round nodes take the label of greatest edge weight among their neighbours (ties: the
    smallest label). In each round a different half of the nodes, chosen by hash, may move, so that neighbours don't
    swap labels for ever; it ends when no node wants to move, or after two times `rounds` halves. Isolated nodes keep
    their own label. Edges are made once. Up to LABELS nodes' labels are sent to the edges in every round; those of more
    nodes are joined to them, and the lineage is cut every round by a checkpoint."""
    edges = edges.select("src", "dst", "w").checkpoint(eager=True)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).filter("src <> dst")
    if (n := nodes.count()) <= LABELS:
        return _sent_labels(nodes, both, n, rounds)
    labels = nodes.select("node_id", F.col("node_id").alias("label"))
    for k in range(2 * rounds):
        votes = both.join(labels.select(F.col("node_id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct((-F.col("w")).alias("a"), "label")).alias("best"))
        new = labels.join(best.withColumnRenamed("src", "node_id"), "node_id", "left").withColumn("best", F.coalesce("best", "label"))
        new = new.select("node_id", F.when(_moves(k), F.col("best")).otherwise(F.col("label")).alias("label"), (F.col("best") != F.col("label")).alias("wants")).checkpoint(eager=True)
        labels = new.select("node_id", "label")
        if not new.filter("wants").limit(1).count():
            break
    return labels


def _moves(k: int) -> Column:
    return F.pmod(F.xxhash64("node_id", F.lit(k)), F.lit(2)) == 0


def _sent_labels(nodes: DataFrame, both: DataFrame, n: int, rounds: int) -> DataFrame:
    """Label propagation with all labels as one array of ranks of node ids, which every round's tasks are sent. Edges lie
    by their node in one packed row a partition, so a round is one stage without a shuffle."""
    spark, halves = nodes.sparkSession, 2 * rounds
    turns = reduce(Column.__add__, [F.when(_moves(k), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(halves)]) if halves else F.lit(0)
    table = nodes.select("node_id", turns.cast("long").alias("turns")).toArrow().combine_chunks()
    table = table.take(pc.sort_indices(table, sort_keys=[("node_id", "ascending")]))
    ids, turns, label = table["node_id"].combine_chunks(), table["turns"].to_numpy(), np.arange(n)
    sent_ids = spark.sparkContext.broadcast(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if got:
            every = pa.Table.from_batches(got)
            src, dst = (pc.index_in(every[c].combine_chunks(), value_set=sent_ids.value) for c in ("src", "dst"))
            both_known = pc.and_(src.is_valid(), dst.is_valid())
            known = [x.filter(both_known).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst)]
            w = every["w"].combine_chunks().filter(both_known).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([np.concatenate(known).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["ends", "w"])

    packed = both.repartition(max(1, min(spark.sparkContext.defaultParallelism, -(-n // LEAST))), "src").mapInArrow(pack, "ends binary, w binary").persist()
    for k in range(halves):
        sent = spark.sparkContext.broadcast(label)

        def vote(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            label = sent.value
            for batch in batches:
                for ends, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    src, dst = np.frombuffer(ends, np.int64).reshape(2, -1)
                    if len(src):
                        key = src * len(label) + label[dst]
                        order = np.argsort(key, kind="stable")
                        first = np.flatnonzero(np.diff(key[order], prepend=-1))
                        weight = np.add.reduceat(np.frombuffer(w)[order], first).round(9)
                        node, own = np.divmod(key[order][first], len(label))
                        order = np.lexsort((own, -weight, node))
                        first = np.flatnonzero(np.diff(node[order], prepend=-1))
                        yield pa.record_batch([pa.array([np.concatenate([node[order][first], own[order][first]]).tobytes()], pa.binary())], ["best"])

        best = label.copy()
        for row in packed.mapInArrow(vote, "best binary").collect():
            node, own = np.frombuffer(row["best"], np.int64).reshape(2, -1)
            best[node] = own
        sent.unpersist()
        wants = best != label
        label = np.where((turns >> k) & 1 == 1, best, label)
        if not wants.any():
            break
    packed.unpersist()
    schema = nodes.select("node_id", F.col("node_id").alias("label")).schema
    return spark.createDataFrame(pa.table({"node_id": ids, "label": ids.take(pa.array(label))}), schema)


def community_summaries(labels: DataFrame, texts: DataFrame, first: int = 5) -> DataFrame:
    """(label, size, summary): members, and the first sentences of the first few by id."""
    t = F.coalesce("text", F.lit(""))
    sentence = F.when(t.contains(". "), F.split(t, r"\. ")[0]).otherwise(F.substring(t, 1, 100))
    w = Window.partitionBy("label").orderBy("node_id")
    rows = labels.join(texts, "node_id").select("label", "node_id", sentence.alias("s")).withColumn("rn", F.row_number().over(w))
    return rows.groupBy("label").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= first, F.struct("rn", "s")))), lambda x: x["s"]), " ").alias("summary"))


def expand(run: DataFrame, communities: DataFrame, k: int = 10, seeds: int = 3, score: float = 0.3) -> DataFrame:
    """The run with the members of its first documents' communities added at a fixed score (0.3 hybrid, 0.5 graph).
    `communities` has doc_id and label; a document may have several labels."""
    top = run.filter(F.col("rank") <= seeds).select("query_id", "doc_id").join(communities, "doc_id").select("query_id", "label").distinct()
    members = top.join(communities, "label").select("query_id", "doc_id").distinct()
    new = members.join(run.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(score))
    return ranked(run.select("query_id", "doc_id", "score").unionByName(new), k)



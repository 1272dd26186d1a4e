"""Rows with repeated and null ids, hubs, and components that need many rounds."""

import random

import pytest
from pyspark.sql import functions as F

from quillfind.llm import components, near, shared, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")


def test_warc_keeps_repeated_and_null_ids(spark):
    a, b = "a" * 150, "b" * 150
    rows = [(5, a), (2, a), (5, b), (None, a), (7, "short"), (7, "short"), (8, b), (9, "c" * 200), (9, "c" * 200)]
    index, _ = warc.archive(pages(spark, rows))
    got = sorted((tuple(r) for r in warc.read_back(index).collect()), key=str)
    d = warc.digest_of
    expected = [(5, 150, d(a), "revisit", 2), (2, 150, d(a), "response", None), (5, 150, d(b), "response", None), (None, 150, d(a), "revisit", 2), (8, 150, d(b), "revisit", 5)]
    expected += [(7, 5, d("short"), "response", None)] * 2 + [(9, 200, d("c" * 200), "response", None)] * 2
    assert got == sorted(expected, key=str)
    ids = [r["record_id"] for r in index.collect()]
    assert len(set(ids)) == len(rows)


def test_warc_hot_payload(spark, monkeypatch):
    """A payload that a third of the pages share is joined by broadcast."""
    monkeypatch.setattr(shared, "HOT_KEYS", 2)
    rows = [(i, "x" * 120 if i % 3 == 0 else "y" * 120 + str(i // 2)) for i in range(6000)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_back(warc.archive(pages(spark, rows))[0]).collect()}
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    assert got == {i: ("response", None) if first[h] == i else ("revisit", first[h]) for i, h in rows}


def links_by_force(rows, n=4, num=85, den=100):
    """component per id, where an id can have several texts"""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            j, both = rows[y][0], len(sets[x] & sets[y])
            if i is not None and j is not None and sets[x] and sets[y] and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)]


def test_near_keeps_links_of_repeated_ids(spark):
    r = random.Random(9)
    base, other, third = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "abc")
    rows = [(1, base), (1, other), (2, base + " q"), (3, other + " q"), (4, third), (5, third + " z"), (5, None), (5, third), (None, base), (None, base), (6, ""), (0, third + " y"), (7, "lone words"), (7, "lone words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in near.link_components(df).collect()), key=str)
    assert got == sorted(links_by_force(rows), key=str)


def test_near_hub(spark, monkeypatch):
    """A centre with far more pairs than a group may have, and copies of its text that are joined by broadcast."""
    monkeypatch.setattr(near, "GROUP", 7)
    monkeypatch.setattr(shared, "HOT_KEYS", 2)
    w = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join([*w[: i % 50], f"x{i}", *w[i % 50 + 1 :]]) if i % 3 else " ".join(w)) for i in range(300)] + [(1000 + i, f"other text number {i} here") for i in range(30)]
    got = {x["doc_id"]: x["component_id"] for x in near.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in links_by_force(rows)}


def test_hub_pairs_are_spread(spark, monkeypatch):
    """50,000 pairs of one centre: no group of the join has more than about GROUP of them."""
    pairs = spark.range(1, 50_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    table = spark.range(50_001)
    out = near._with_sides(pairs, table.select(F.col("id").alias("a"), F.col("id").alias("x")), table.select(F.col("id").alias("b"), F.col("id").alias("y")))
    assert out.filter("x = a and y = b").count() == 50_000
    dealt = pairs.select(F.pmod(F.xxhash64("a", "b"), F.lit(-(-50_000 // near.GROUP))).alias("g")).groupBy("g").count().agg(F.max("count")).first()[0]
    assert dealt < 1.2 * near.GROUP


@pytest.mark.parametrize("size,task_edges", [(2, 1_000_000), (400, 1_000_000), (300, 40)])
def test_components_of_a_path(spark, monkeypatch, size, task_edges):
    """In one task, and by steps over several forests."""
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    r = random.Random(size)
    names = list(range(size))
    r.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(size - 1)] + [(10**6, 10**6 + 1), (5, 5), (10**6 + 1, 10**6)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    got = {x["node"]: x["label"] for x in components.components(df).collect()}
    assert got == {**{n: 0 for n in names}, 10**6: 10**6, 10**6 + 1: 10**6}
    assert components.components(df.limit(0)).count() == 0

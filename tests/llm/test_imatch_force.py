"""Fingerprints, likenesses and neighbours against plain Python, with far ids, repeated ids, null ids and one row."""

import hashlib
import random
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quillfind.llm import imatch


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def xx(values, seed=42):
    """Spark's xxhash64: each value's hash is the next one's seed. Values: str, ("i", int) or long."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def terms(text):
    return sorted({t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}, key=str.encode)


def fingerprint(text, lexicon):
    band = sorted(h for h in (xx([t]) for t in terms(text)) if h in lexicon)
    whole = xx(band) if band else xx(terms(text))
    families = []
    for k in range(1, imatch.SUBSETS + 1):
        inside, family = band, []
        for level in range(imatch.LEVELS):
            inside = [t for t in inside if ((xx([t, ("i", k)]) % (1 << 64)) >> (2 * level)) & 3 == 0]
            family.append(xx(inside) if inside else 0)
        families.append(family)
    return whole, families


def likeness(x, y):
    if x[0] == y[0]:
        return 1.0
    best = 0.0
    for k in range(imatch.LEVELS):
        a, b = [v for f in x[1] for v in f[k:]], [v for f in y[1] for v in f[k:]]
        some = sum(p != 0 or q != 0 for p, q in zip(a, b))
        best = max(best, sum(p == q != 0 for p, q in zip(a, b)) / some if some else 0.0)
    return best


def text_of(print_):
    part = ["-" if x == 0 else f"{x & 0xFFFFFFFF:x}" for f in print_[1] for x in f]
    return ".".join([f"{print_[0] & (1 << 64) - 1:x}", *part])


def by_force(rows):
    rows = [(i, t or "") for i, t in rows]
    df = {}
    for _, t in rows:
        for x in terms(t):
            df[xx([x])] = df.get(xx([x]), 0) + 1
    lexicon = {h for h, n in df.items() if max(2, imatch.LOW * len(rows)) <= n <= imatch.HIGH * len(rows)}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xx([r[1]]), r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 3
        edited = t[: len(t) - q] + after[:q]
        own, changed, follow = (fingerprint(x, lexicon) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(changed), round(likeness(own, changed), 9), round(likeness(own, follow), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,cells", [(512, 2048), (4, 2048), (2, 3)])
def test_matches_plain_python(spark, monkeypatch, block, cells):
    monkeypatch.setattr(imatch, "BLOCK", block)
    monkeypatch.setattr(imatch, "CELLS", cells)
    r = random.Random(8)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi é1 ü2".split()) + str(r.randrange(4))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 30)))) for i in range(40)]
    rows += [(7, rows[8][1]), (7, "another text of seven"), (1 << 60, rows[3][1] + " end"), (-5, None), (-6, ""), (None, "a null id"), (None, rows[5][1]), (41, "word " * 3000)]
    rows += [(500, " ".join(word() for _ in range(9))) for _ in range(25)] + [(500, rows[1][1])] * 2
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, block string").repartition(3)
    got = sorted((tuple(x[:5]) + (round(x[5], 9), round(x[6], 9)) for x in imatch.compared(imatch.fingerprints(df)).collect()), key=str)
    assert got == by_force(rows)


def test_one_row(spark):
    got = imatch.compared(imatch.fingerprints(spark.createDataFrame([(3, "one two")], "doc_id long, text string"))).collect()
    assert [(x["doc_id"], x["near_next"]) for x in got] == [(3, 1.0)]


def test_far_id_leaves_blocks_alone(spark):
    docs = spark.range(20_000).unionByName(spark.createDataFrame([((1 << 60),), (-(1 << 60),)], "id long")).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("text hash"))
    assert imatch._blocks(docs).groupBy("block").count().agg(F.max("count")).first()[0] < 4 * imatch.BLOCK


def test_hot_id_is_split(spark):
    docs = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text hash"))
    assert imatch._blocks(docs).groupBy("block").count().agg(F.max("count")).first()[0] < 4 * imatch.BLOCK

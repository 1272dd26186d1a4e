"""Exact n-gram Jaccard self-join by parity sketches, and its connected components.

A document's set is its distinct n-word shingles (hashed to 64 bits). Equal sets meet by a 128-bit digest and need no
join. For the others:
 1. Sizes are cut into bands whose ends differ by the similarity bound, so linked sets lie in one band or in two
    adjacent ones. In a band no linked pair differs in more than d shingles.
 2. XOR-hashing every shingle into one of d+1 segments gives a parity sketch. A shingle in which two sets differ
    changes one segment, so linked sets agree in at least one whole segment (pigeonhole). A segment's parity bits are
    kept as one 64-bit key; a set sends its keys to its own band and, where it can link upwards, to the next. All keys
    are sent, in ROUNDS runs over the texts, so that their shuffles are on disk one after the other.
    Agreement on an empty segment tells nothing. So there are e spare segments, linked sets agree in e+1, and one of
    these is filled unless both sets have more than e empty ones. Sets that do (few) also send the keys of a second,
    third and fourth sketch with other seeds, and after the fourth the empty segments themselves. No link is lost.
 3. Sets that share a key are compared with two of them, the smallest and the largest id. These pairs are as many as
    the keys at most, are made distinct, are dropped if sizes or the Hamming distance of parity sketches (a
    lower bound of the difference) rule a link out, and are verified exactly on the whole sets.
    A set that very many pairs have (the centre of a large group) is sent to several groups of its pairs.
 4. A key whose sets are one component already needs nothing more. The sets of other keys (with three or more sets)
    are gathered by key sharing into clusters, and their sketches dealt to pairs of blocks of bounded size. Pairs of
    different components that sizes and sketches don't rule out are verified exactly as above.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own component; with
fewer than n words, the whole word sequence is the one shingle; a row that is there twice is a copy of itself; an id
with several texts links by each of them, and all its rows have one component; null ids are carried through and link
with nothing; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U, mix, ngrams, slices, split_words
from .components import components
from .shared import HOT_KEYS, free, join_hot, session, stored, without_hot

WORDS, NUM, DEN = 4, 85, 100
#: Sets in a block of step 4, and document ids that are broadcast at most (8 bytes each).
BLOCK, BROADCAST_IDS = 8192, 1_000_000
#: Pairs of one set that are joined with it in one group.
GROUP = 1024
#: Runs over the texts in which keys are sent, a part of all keys in each: only one part's shuffle is on disk at a time.
ROUNDS = 3
LEVELS = 4
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
FEATURES = "doc_id long, n long, h1 long, h2 long, sketch array<long>"
#: Least 64-bit words of the parity sketch that candidates are tested with before their sets are fetched; larger sets
#: have two bits a shingle at least, in a power of two.
SKETCH = 16


def spare(differ: int) -> int:
    """Segments beyond d+1: more than sets of the band have empty, save a few sets in a hundred."""
    return 2 + differ // 32


def bands(largest: int, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper ends of the size bands, their segments (one more than two linked sets of the band can differ by, and the
    spare ones) and the spare ones. Where linked sets cannot differ they are equal; such bands have no segments."""
    ends, differs, low = [], [], 1
    while not ends or ends[-1] < largest:
        end = low * den // num
        differ = (2 * end * (den - num)) // (den + num)
        ends.append(end)
        differs.append(differ)
        low = end + 1
    ends.append(low * den // num)
    differs.append((2 * ends[-1] * (den - num)) // (den + num))
    return np.array(ends), np.array([d + 1 + spare(d) if d else 0 for d in differs]), np.array([spare(d) for d in differs])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = split_words(data, offsets)
    grams, at = ngrams(words, n)
    first = np.searchsorted(at, words.first)
    out = []
    counts = np.diff(words.first)
    for t in range(len(offsets) - 1):
        if first[t + 1] > first[t]:
            out.append(np.unique(grams[first[t] : first[t + 1]]))
        elif counts[t]:
            h = U(counts[t])
            with np.errstate(over="ignore"):
                for w in words.hash[words.first[t] : words.first[t + 1]]:
                    h = mix(np.array([h * _C1 ^ w]))[0]
            out.append(np.array([h], dtype=U))
        else:
            out.append(np.zeros(0, U))
    return out


def _segment_keys(sets: list[np.ndarray], band: np.ndarray, segments: np.ndarray, spares: np.ndarray, level: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of each set's segments in the given band, and which sets have more empty segments than spare ones."""
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    with np.errstate(over="ignore"):
        if level:
            h = mix(h ^ (_C2 * U(level)))
            h = h[np.lexsort((h, owner))]
        seg = ((h >> U(32)) * segments[owner].astype(U)) >> U(32)
        base = np.concatenate([[0], np.cumsum(segments)])
        place = base[owner] + seg.astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        parity = np.bitwise_xor.reduceat(mix(h ^ _C3), first)
        where, who = place[first], owner[first]
        keys = mix(parity + _C1 * (where - base[who]).astype(U) + _C2 * band[who].astype(U) + _C3 * U(level + 1))
    edges = np.searchsorted(who, np.arange(len(sets) + 1))
    filled = np.diff(edges)
    out = [keys[a:b] for a, b in zip(edges, edges[1:])]
    empty = segments - filled > spares
    if level == LEVELS - 1:
        for i in np.flatnonzero(empty).tolist():
            present = np.zeros(segments[i], bool)
            present[(where[edges[i] : edges[i + 1]] - base[i])] = True
            with np.errstate(over="ignore"):
                out[i] = np.concatenate([out[i], mix(_C1 * np.flatnonzero(~present).astype(U) + _C2 * U(band[i]) + U(77))])
    return out, empty


def sketch_keys(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[np.ndarray]:
    """All keys that each set sends."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ends, segments, spares = bands(int(sizes.max(initial=1)), num, den)
    own = np.searchsorted(ends, sizes)
    keys: list[list[np.ndarray]] = [[] for _ in sets]
    for up in (0, 1):
        band = own + up
        use = np.flatnonzero((sizes > 0) & (segments[band] > 0) & ((up == 0) | (sizes * den >= num * (ends[own] + 1))))
        for level in range(LEVELS):
            if not len(use):
                break
            got, empty = _segment_keys([sets[i] for i in use], band[use], segments[band[use]], spares[band[use]], level)
            for i, k in zip(use.tolist(), got):
                keys[i].append(k)
            use = use[empty]
    return [np.concatenate(k) if k else np.zeros(0, U) for k in keys]


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a, b = mix(s ^ _C1).sum(dtype=U) + U(len(s)), np.bitwise_xor.reduce(mix(s ^ _C2)) ^ (_C3 * U(len(s)))
    return int(a.astype(np.int64)), int(np.array(b, dtype=U).astype(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """Every shingle flips one bit of the sketch: sets differ in at least as many shingles as sketches in bits. The
    halves of a sketch, XORed, are the sketch of half the size."""
    bits = max(64 * SKETCH, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64 * SKETCH
    spot = (mix(s.astype(U)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(np.uint8)).view(U)


def _fold(m: np.ndarray) -> np.ndarray:
    half = m.shape[-1] // 2
    return m[..., :half] ^ m[..., half:]


def features(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, set size, 128-bit digest, parity sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                digests = [_digest(s) for s in sets]
                yield pa.record_batch([batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([parity(s).astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, FEATURES)


def keys_of(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN, rounds: int = 1, part: int = 0) -> DataFrame:
    """(key, rep): every key that a document's set sends; of several rounds' keys those of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in slices(batch.column(1)):
                keys = sketch_keys(shingle_sets(data, offsets, n), num, den)
                owner = np.repeat(ids[at : at + len(keys)], [len(k) for k in keys])
                every = np.concatenate(keys)
                if rounds > 1:
                    mine = every % U(rounds) == U(part)
                    every, owner = every[mine], owner[mine]
                every = every.astype(np.int64)
                for x in range(0, len(every), 1 << 18):
                    yield pa.record_batch([pa.array(every[x : x + (1 << 18)]), pa.array(owner[x : x + (1 << 18)])], ["key", "rep"])

    return docs.mapInArrow(run, "key long, rep long")


def few(ids: DataFrame) -> bool:
    """Whether ids are few enough to be broadcast."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles array) of the documents in `ids`. Their ids are broadcast where they are few enough; else
    texts and ids are joined by a shuffle."""
    mine = docs.join(F.broadcast(ids) if few(ids) else ids.hint("merge"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                flat = np.concatenate(sets or [np.zeros(0, U)]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "shingles"])

    # Rows with one id are copies or different texts under one id; the representative is any one of an equal set.
    return mine.mapInArrow(run, "doc_id long, shingles array<long>")


def _linked(a, b, num: int, den: int):
    both = F.size(F.array_intersect(a, b))
    return both * den >= (F.size(a) + F.size(b) - both) * num


def _compare_blocks(num: int, den: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs with different labels, of one pair of blocks, that sizes and sketches don't rule out. Sets are ordered
        by size, so each is compared with those of a size that it can link with only."""
        own = group["block_i"].iloc[0] == group["block_j"].iloc[0]
        group = group.sort_values(["n", "rep"], kind="stable")
        sides = [group] * 2 if own else [group[group["side"] == k] for k in (0, 1)]
        (rep, n, label), (rep2, n2, label2) = [(g["rep"].to_numpy(), g["n"].to_numpy(), g["label"].to_numpy()) for g in sides]
        bits = [np.asarray(x, dtype=np.int64).view(U) for x in sides[0]["sketch"]]
        # The right side's sketches by width, which grows with the size: each width is one run of rows.
        widths = np.array([len(x) for x in sides[1]["sketch"]], dtype=np.int64)
        runs = {w: (int(np.searchsorted(widths, w, "left")), int(np.searchsorted(widths, w, "right"))) for w in np.unique(widths).tolist()}
        tables = {w: np.stack([np.asarray(x, dtype=np.int64) for x in sides[1]["sketch"].iloc[x0:x1]]).view(U) for w, (x0, x1) in runs.items()}
        folded = {w: _fold(t) for w, t in tables.items() if w > SKETCH}
        low, high = np.searchsorted(n2, -(-n * num // den), "left"), np.searchsorted(n2, n * den // num, "right")
        out = []
        for k in range(len(rep)):
            mine, w = bits[k], len(bits[k])
            for other, (x0, x1) in runs.items():
                x, y = max(low[k], k + 1 if own else 0, x0), min(high[k], x1)
                if y <= x or other not in (w, 2 * w, w // 2):
                    continue
                theirs = (folded[other] if other > w else tables[other])[x - x0 : y - x0]
                apart = np.bitwise_count(theirs ^ (_fold(mine) if other < w else mine)).sum(axis=1, dtype=np.int64)
                hit = x + np.flatnonzero((apart * (den + num) <= (n2[x:y] + n[k]) * (den - num)) & (label2[x:y] != label[k]))
                out.append(np.stack([np.full(len(hit), rep[k]), rep2[hit]]))
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": pairs.min(axis=0), "b": pairs.max(axis=0)})

    return compare


def _with_sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the columns of `left` (one row per a) and of `right` (one row per b). Where an end has more
    than GROUP pairs, they are dealt to groups before anything wide moves, and its row is sent to each group."""
    keys = {"a": ["a"], "b": ["b"]}
    tables, dealt = {"a": left, "b": right}, {}
    # Ends are counted on the pairs as they came and those with many, fewer than HOT_KEYS, broadcast: no join runs twice.
    for end in keys:
        counts = pairs.groupBy(end).agg(F.count("*").alias("pairs of it"))
        size = counts.agg(F.max("pairs of it").alias("most"), F.sum("pairs of it").alias("n")).first()
        least = max(GROUP, (size["n"] or 0) // HOT_KEYS)
        if (size["most"] or 0) > least:
            group = f"group {end}"
            groups = stored(counts.filter(F.col("pairs of it") > least).select(F.col(end), F.ceil(F.col("pairs of it") / GROUP).cast("int").alias("groups")), "near-groups")
            keys[end], dealt[end] = [end, group], groups
            tables[end] = tables[end].join(F.broadcast(groups), end, "left").withColumn(group, F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1))).drop("groups")
    for end, groups in dealt.items():
        pairs = pairs.join(F.broadcast(groups), end, "left").withColumn(f"group {end}", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("groups")).cast("int"), F.lit(0))).drop("groups")
    return pairs.join(tables["a"], keys["a"]).join(tables["b"], keys["b"]).drop("group a", "group b")


def _met(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(key, rep, members, first, last) of the keys that two or more of the documents send; stored. One shuffle a round,
    removed before the next; a key that very many sets share is buffered in a spilling array, not collected."""
    key = Window.partitionBy("key")
    found = None
    for part in range(ROUNDS):
        free(docs.sparkSession)
        keyed = keys_of(docs, words, num, den, ROUNDS, part)
        met = keyed.withColumns({"members": F.count("*").over(key), "first": F.min("rep").over(key), "last": F.max("rep").over(key)})
        met = stored(met.filter("members > 1"), "near-keys")
        found = met if found is None else found.unionByName(met)
        del keyed
    free(docs.sparkSession)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; stored."""
    pairs = stored(pairs, "near-pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    of = _sets_of(docs, ids, words).dropDuplicates(["doc_id"])
    both = _with_sides(pairs, of.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), of.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")))
    return stored(both.filter(_linked(F.col("x"), F.col("y"), num, den)).select("a", "b"), "near-links")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row. Two documents link when den * intersection >=
    num * union; component_id is the smallest doc_id reachable by links."""
    session(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(features(docs, words), "near-features")
    repeated = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), *[f(h).alias(f"{f.__name__} {h}") for h in ("h1", "h2") for f in (F.min, F.max)]).filter("n > 1")
    repeated = stored(repeated.select("doc_id", "n", ((F.col("min h1") != F.col("max h1")) | (F.col("min h2") != F.col("max h2"))).alias("differ")), "near-repeated")
    if not repeated.filter("differ").limit(1).count():
        return _linked_rows(docs, rows, repeated.select("doc_id"), words, num, den)
    return _repeated_ids(docs, repeated.filter("differ"), words, num, den)


def _repeated_ids(docs: DataFrame, odd: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The same where some ids (`odd`, with the number of their rows) have different texts: each of their texts is a
    node of its own, and the components that an id's texts lie in become one."""
    nodes = stored(docs.join(F.broadcast(odd.select("doc_id")) if few(odd) else odd.select("doc_id").hint("merge"), "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "doc_id", "text").unionByName(join_hot(docs, odd.drop("differ"), "doc_id", "n").select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", "text")), "near-nodes")
    named = nodes.select(F.col("node").alias("doc_id"), "text")
    rows = stored(features(named, words), "near-features")
    twice = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    linked = stored(_linked_rows(named, rows, stored(twice, "near-repeated"), words, num, den).select(F.col("doc_id").alias("node"), "n_shingles", "component_id"), "near-linked")
    of_node = linked.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component"))
    # (row's id, its component): one row per input row, by a node that many rows may share only if they are equal.
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n"))
    known = stored(join_hot(nodes.filter("node is not null").select("node", "doc_id"), of_node.join(sizes, "node"), "node", "n"), "near-known")
    together = known.groupBy("doc_id").agg(F.min("component").alias("a"), F.max("component").alias("z")).filter("a <> z").select("doc_id", "a")
    edges = join_hot(known.select("doc_id", "component"), together.join(odd, "doc_id"), "doc_id", "n").select("a", F.col("component").alias("b")).distinct()
    joined = components(stored(edges, "near-edges"))
    final = known.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(joined.withColumnRenamed("node", "component"), "component", "left").withColumn("label", F.coalesce("label", "component"))
    least = final.groupBy("label").agg(F.min("least").alias("component_id"))
    out = join_hot(known.select("doc_id", "n_shingles", "component"), final.select("component", "label", "n").join(least, "label").drop("label"), "component", "n").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(linked.filter("node is null").select(F.col("node").alias("doc_id"), "n_shingles", "component_id"))


def _linked_rows(docs: DataFrame, rows: DataFrame, repeated: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """link_components where an id has one text. rows: the documents' features; repeated: ids of more than one row."""
    full = rows.filter("n > 0 and doc_id is not null")
    # Equal sets become one, under their smallest id. Only copies are joined back; groups are pre-aggregated.
    copies = stored(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").withColumn("set", F.concat_ws(":", "h1", "h2")).select("set", "rep", "copies"), "near-copies")
    slim = full.select("doc_id", F.concat_ws(":", "h1", "h2").alias("set"))
    gone = join_hot(slim, copies, "set", "copies").filter("doc_id <> rep").select("doc_id").join(F.broadcast(repeated) if few(repeated) else repeated.hint("merge"), "doc_id", "left_anti")
    gone = stored(gone, "near-gone")
    own = docs.filter("doc_id is not null").join(F.broadcast(gone) if few(gone) else gone.hint("merge"), "doc_id", "left_anti")
    met = _met(own, words, num, den)

    star = met.select("rep", F.explode(F.array_distinct(F.array("first", "last"))).alias("center")).filter("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
    # Rows that are there twice have one sketch.
    light = full.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    side = lambda end: light.select(F.col("doc_id").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))
    star = _with_sides(stored(star, "near-stars"), side("a"), side("b"))
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    star = star.withColumn("sa", F.when(F.size("sa") > F.size("sb"), half(F.col("sa"))).otherwise(F.col("sa"))).withColumn("sb", F.when(F.size("sb") > F.size("sa"), half(F.col("sb"))).otherwise(F.col("sb")))
    # Sizes that may link differ by less than two, so one fold makes the sketches equally wide; others are ruled out.
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0)))
    close = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num))
    star = star.filter(close).select("a", "b")
    links = _verified(star, docs, words, num, den)
    del star
    free(docs.sparkSession)
    labels = components(links)

    # Keys of three sets or more that are not one component yet.
    open_rows = met.filter("members > 2").select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_keys = open_rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("rep").alias("first")).filter("low <> high").select("key", "first")
    rest = stored(open_rows.join(open_keys, "key").select("rep", "first", "label").distinct(), "near-open")
    if rest.limit(1).count():
        clusters = components(rest.select(F.col("rep").alias("a"), F.col("first").alias("b")))
        members = rest.select("rep", "label").distinct().join(clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")), "rep")
        sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = members.join(sizes, "cluster").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("cluster", "rep", "label", F.least("mine", "other").alias("block_i"), F.greatest("mine", "other").alias("block_j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
        dealt = dealt.join(light.withColumnRenamed("doc_id", "rep"), "rep")
        more = dealt.groupBy("cluster", "block_i", "block_j").applyInPandas(_compare_blocks(num, den), "a long, b long").distinct()
        links = links.unionByName(_verified(more, docs, words, num, den))
        labels = components(links)

    # Copies by their set (a set that very many have is broadcast), all others by their id.
    names = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("label", "rep").alias("label"), "copies")
    every = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.concat_ws(":", "h1", "h2")).alias("set"))
    copied = join_hot(every, names, "set", "copies").select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    lone = without_hot(every, copies, "set", "copies").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    lone = lone.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return copied.unionByName(lone)

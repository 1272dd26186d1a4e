"""Interpolated modified Kneser-Ney n-gram model of order 2 or 3: counted in Spark, kept as sorted arrays, memory-mapped
by workers.

Tokens are words, lower-cased in A-Z, then one end mark per text; a begin mark is the first word's context only. A text's
first token has that context alone, and the second token of order 3 has the begin mark and the first token.

Build; no shuffle is of single tokens, and every task counts before it sends one block per range:
 1. Words: blocks of (sorted hashes, counts) per hash range. A range's merge writes its sorted hash array and counts; a
    word's id is its rank over all ranges.
 2. Pairs: tasks look ids up and count keys `id << 32 | id`. Key ranges are cut by the words' counts, so that they carry
    equal weight; a word too frequent for one range is cut further by its followers. A range's merge writes its sorted
    keys and counts; a pair's rank counts over all ranges.
 3. Triples (order 3): the same once more with `pair's rank << 32 | id`, ranks beyond 32 bits in groups of 2**32. A merge
    also writes how many followers its pairs have, and tells the pairs' ranges how many triples end in each pair.
 4. What ranges know of their contexts (followers seen once, twice, oftener; totals) is summed per hash range.
Keys of pairs and triples are stored as whole numbers without gaps (word id times distinct words plus word id), the first
of every 32 in full and the others as distances from it, of four bytes and more only where a range needs them; a lookup
reads the first keys and at most six distances. The driver holds only sizes, cuts and counts of counts: a few numbers per range. Ranges hold RANGE_BYTES of text
whatever the corpus, nothing is pruned or sampled, so model and traffic grow with the corpus. Word ids are 32 bits wide;
a corpus with more distinct words raises an error.

Scoring maps the arrays that its texts' words fall in (from the shared folder where it is mounted, else from an unnamed
scratch copy) and looks up the sorted distinct keys of each slice of texts. No shuffle.

Defined results: null and empty texts consist of the end mark; with nothing to learn from, every token has
probability 1; repeated rows count as often as they stand there; rows with null ids are learned from and scored; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import U, slices, split_words
from .shared import free, fresh_folder, map_file, session, write_file

BEGIN, END = U(0x0B0E_61A1_57A1_0001), U(0x0E4D_0F7E_0712_0002)
#: Bytes of text per range, and entries that a task counts before it sends them on.
RANGE_BYTES, FLUSH = 24 << 20, 3_000_000
ORDER, LOW32 = 3, U(0xFFFFFFFF)
#: Stored keys per one that is stored in full; a power of 2.
RUN = 32
BLOCK = "bucket int, kind string, keys binary, counts binary"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of one weight together: most high bytes are zeros."""
    gaps = np.diff(keys, prepend=U(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(data, np.uint8).reshape(8, -1).T).view(U).ravel(), dtype=U)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts; counts may have several columns."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end mark after each text, and each text's first position."""
    words = split_words(data, offsets)
    n = len(offsets) - 1
    first = words.first + np.arange(n + 1)
    out = np.empty(first[-1], dtype=U)
    ends = first[1:] - 1
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = words.hash
    out[ends] = END
    return out, first


def contexts(ids: np.ndarray, first: np.ndarray, begin) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = begin
    return before


def grouped(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places) of each distinct value, in time that does not grow with how many are distinct."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    for places in np.split(order, np.flatnonzero(own[1:] != own[:-1]) + 1):
        if len(places):
            yield int(values[places[0]]), places


class Counter:
    """Counts keys of several arrays with bounded memory."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c.astype(np.uint32)))
        self.size += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merged(np.concatenate([p[0] for p in self.parts] or [np.zeros(0, U)]), np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.uint32)]))
        self.parts, self.size = [], 0
        return k, c.astype(np.uint32)

    def compact(self) -> None:
        if len(self.parts) > 1:
            k, c = self.take()
            self.parts, self.size = [(k, c)], len(k)


def _blocks(kind: str, keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, dtype=np.uint32) -> pa.RecordBatch:
    """One block per range that has keys; cuts: first keys of the ranges after the first."""
    edges = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    counts = counts.astype(dtype)
    rows = [(b, pack_keys(keys[x:y]), pack(counts[x:y])) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "keys", "counts"])


def _counted(batches: Iterator[pa.RecordBatch], keys_of, cuts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """keys_of gives (kind, keys) of a slice of texts; each kind has its own ranges."""
    counters, unmerged = {kind: Counter() for kind in cuts}, 0
    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            for kind, keys in keys_of(data, offsets):
                counters[kind].add(keys)
            unmerged += 1
            if unmerged >= 8:
                for c in counters.values():
                    c.compact()
                unmerged = 0
            if sum(c.size for c in counters.values()) > FLUSH:
                for kind, c in counters.items():
                    yield _blocks(kind, *c.take(), cuts[kind])
    for kind, c in counters.items():
        yield _blocks(kind, *c.take(), cuts[kind])


def _merged_blocks(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return merged(np.concatenate([unpack_keys(x) for x in group["keys"]]), np.concatenate([unpack(x, np.uint32) for x in group["counts"]]).astype(np.int64))


def write_counts(uri: str, counts: np.ndarray) -> None:
    """One byte per count; those beyond it stand at the file's beginning with their places."""
    big = np.flatnonzero(counts > 254)
    write_file(uri, [np.array([len(big)], U).tobytes(), big.astype(U).tobytes(), counts[big].astype(U).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes()])


class Counts:
    """A mapped array of counts."""

    def __init__(self, uri: str):
        data = map_file(uri, np.uint8)
        n = int(data[:8].view(U)[0])
        self.place, self.value, self.small = data[8 : 8 + 8 * n].view(U), data[8 + 8 * n : 8 + 16 * n].view(U), data[8 + 16 * n :]

    def take(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.value[np.searchsorted(self.place, at[big].astype(U))].astype(np.int64)
        return out

    def all(self) -> np.ndarray:
        return self.take(np.arange(len(self.small)))


def _dense(keys: np.ndarray, span: int) -> np.ndarray:
    """Keys `high << 32 | low` with low < span as whole numbers in the same order."""
    return (keys >> U(32)) * U(span) + (keys & LOW32)


def write_keys(uri: str, keys: np.ndarray, span: int) -> None:
    """Sorted distinct keys: of each RUN the first, then all distances from it, their low four bytes and as many planes of
    higher bytes as the largest needs. The last run is filled up with a distance that no key has."""
    dense = _dense(keys, span)
    first = dense[::RUN]
    away = np.full(len(first) * RUN, ~U(0))
    away[: len(dense)] = dense - np.repeat(first, RUN)[: len(dense)]
    most = int(away[: len(dense)].max(initial=0))
    planes = next(k for k in range(5) if most < (1 << 32 + 8 * k) - 1)
    write_file(uri, [np.array([len(dense), planes], U).tobytes(), first.tobytes(), away.astype(np.uint32).tobytes(), *((away >> U(32 + 8 * k)).astype(np.uint8).tobytes() for k in range(planes))])


class Keys:
    """A mapped array of sorted keys."""

    def __init__(self, uri: str, span: int):
        data = np.asarray(map_file(uri, np.uint8))
        self.n, planes = (int(x) for x in data[:16].view(U))
        self.span, runs = span, -(-self.n // RUN)
        self.first, rest = data[16 : 16 + 8 * runs].view(U), data[16 + 8 * runs :]
        self.low = rest[: 4 * RUN * runs].view(np.uint32)
        self.planes = rest[4 * RUN * runs :].reshape(planes, RUN * runs)

    def __len__(self) -> int:
        return self.n

    def _away(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(U)
        for k, plane in enumerate(self.planes):
            out |= plane[at].astype(U) << U(32 + 8 * k)
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, known)"""
        dense = _dense(keys, self.span)
        run = np.maximum(np.searchsorted(self.first, dense, "right") - 1, 0)
        away, at = dense - self.first[run], run * RUN
        step = RUN // 2
        while step:
            at += step * (self._away(at + step) <= away)
            step //= 2
        known = (dense >= self.first[0]) & (at < self.n) & (self._away(at) == away)
        return np.minimum(at, self.n - 1), known

    def take(self, at: np.ndarray) -> np.ndarray:
        dense = self.first[at // RUN] + self._away(at)
        high = dense // U(self.span)
        return (high << U(32)) | (dense - high * U(self.span))

    def all(self) -> np.ndarray:
        return self.take(np.arange(self.n))


class Ranges:
    """The sorted keys of one kind, cut into ranges and mapped at first use; ranks count over all of them. With a span, the
    number of distinct words, the keys are stored by write_keys; words' hashes are stored as they are."""

    def __init__(self, uri: str, kind: str, cuts: np.ndarray, sizes: list[int], span: int = 0):
        self.uri, self.kind, self.cuts, self.sizes, self.span = uri, kind, np.asarray(cuts, dtype=U), sizes, span
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.mapped: dict[tuple[str, int], object] = {}

    def keys(self, b: int) -> np.ndarray | Keys:
        """Of a range that is not empty."""
        if ("", b) not in self.mapped:
            uri = f"{self.uri}/{self.kind}-{b}"
            self.mapped["", b] = Keys(uri, self.span) if self.span else map_file(uri, U)
        return self.mapped["", b]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: (ranks, known)."""
        ranks, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        edges = [0, *np.searchsorted(keys, self.cuts).tolist(), len(keys)]
        for b, (x, y) in enumerate(zip(edges, edges[1:])):
            if y > x and self.sizes[b]:
                own = self.keys(b)
                if self.span:
                    at, known[x:y] = own.find(keys[x:y])
                else:
                    at = np.minimum(np.searchsorted(own, keys[x:y]), len(own) - 1)
                    known[x:y] = own[at] == keys[x:y]
                ranks[x:y] = at + self.base[b]
        return ranks, known

    def _by_range(self, ranks: np.ndarray, use: np.ndarray):
        used = np.flatnonzero(use)
        for b, places in grouped(np.searchsorted(self.base, ranks[used], "right") - 1):
            mine = used[places]
            yield b, mine, ranks[mine] - self.base[b]

    def key_of(self, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ranks), U)
        for b, mine, at in self._by_range(ranks, np.ones(len(ranks), bool)):
            out[mine] = self.keys(b).take(at)
        return out

    def counts(self, name: str, ranks: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The named counts of the ranks (0 where not known)."""
        out = np.zeros(len(ranks), np.float64)
        for b, mine, at in self._by_range(ranks, known):
            if (name, b) not in self.mapped:
                self.mapped[name, b] = Counts(f"{self.uri}/{self.kind}-{name}-{b}")
            out[mine] = self.mapped[name, b].take(at)
        return out


def hash_cuts(n: int) -> np.ndarray:
    return np.array([(b << 64) // n for b in range(1, n)], dtype=U)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many entries have count 1, 2, 3 and 4; usual constants where those are too few."""
    n1, n2, n3, n4 = n
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _kinds(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts == 1, counts == 2, counts >= 3], axis=1).astype(np.int64)


def _sums(counts: np.ndarray, size: int) -> str:
    return json.dumps([_of_counts(counts), size])


def _sum_row(kind: str, b: int, text: str) -> pd.DataFrame:
    """A range's small results travel with its blocks, in a few groups of their own."""
    return pd.DataFrame([{"bucket": -1 - b % 64, "kind": f"sums {kind} {b}", "keys": b"", "counts": text.encode()}])


def _heads(keys: np.ndarray, counts: np.ndarray, id_cuts: np.ndarray) -> pd.DataFrame:
    """Blocks of what pairs' keys and counts say of the first words: followers by count, and the total."""
    heads, known = merged(keys >> U(32), np.concatenate([_kinds(counts), counts[:, None]], axis=1))
    return _blocks("context", heads, known, id_cuts, np.int64).to_pandas()


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> dict:
    """Learn from all texts. Returns the model: sizes, cuts, discounts and the folder of its arrays."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = session(docs)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = int(max(4, math.ceil(total / RANGE_BYTES)))
    uri = fresh_folder(spark, "lm")
    cuts = hash_cuts(ranges)

    def count_words(batches):
        def keys(data, offsets):
            h, first = sequences(data, offsets)
            return [("word", np.concatenate([h, np.full(len(first) - 1, BEGIN, U)]))]

        return _counted(batches, keys, {"word": cuts})

    def merge_words(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["bucket"].iloc[0])
        keys, counts = _merged_blocks(group)
        write_file(f"{uri}/word-{b}", [keys.tobytes()])
        write_counts(f"{uri}/word-count-{b}", counts)
        # What step 4 finds out replaces these; a range whose words nothing precedes or follows keeps them.
        for name in ("before", "one", "two", "more", "total"):
            write_counts(f"{uri}/word-{name}-{b}", np.zeros(len(keys), np.int64))
        return pd.DataFrame({"bucket": [b], "size": [len(keys)], "mass": [int(counts.sum())], "begin": [int(counts[keys == BEGIN].sum())]})

    found = {r["bucket"]: r for r in texts.mapInArrow(count_words, BLOCK).groupBy("bucket").applyInPandas(merge_words, "bucket int, size long, mass long, begin long").collect()}
    free(spark)
    sizes = [found[b]["size"] if b in found else 0 for b in range(ranges)]
    begins, mass, distinct = sum(r["begin"] for r in found.values()), sum(r["mass"] for r in found.values()), sum(sizes)
    model = {"uri": uri, "order": order, "sizes": sizes, "tokens": mass - begins, "distinct": max(0, distinct - 1), "pairs": 0}
    if not distinct:
        return model
    if distinct >= 1 << 32:
        raise ValueError("more than 2**32 distinct words: split the corpus")
    id_cuts = np.cumsum(sizes)[:-1].astype(U)
    target = max(1, mass // (4 * ranges))

    def cut_points(kind: str, kind_sizes: list[int]) -> list[tuple[int, int]]:
        """(rank, id) pairs that cut a kind's keys into runs of at most about `target` occurrences; frequent ones further,
        by their followers."""
        base = np.concatenate([[0], np.cumsum(kind_sizes)]).astype(np.int64).tolist()

        def of_range(part: pd.DataFrame) -> pd.DataFrame:
            b = int(part["bucket"].iloc[0])
            counts, out = Counts(f"{uri}/{kind}-count-{b}").all(), []
            run = np.cumsum(counts) // target
            for k in np.flatnonzero(np.diff(run, prepend=0) > 0).tolist():
                parts = 1 + int(counts[k]) // target
                out += [(base[b] + k, distinct * i // parts) for i in range(parts)]
            return pd.DataFrame(out, columns=["rank", "id"], dtype="int64")

        filled = spark.createDataFrame([(b,) for b, n in enumerate(kind_sizes) if n], "bucket int")
        return sorted({(r["rank"], r["id"]) for r in filled.groupBy("bucket").applyInPandas(of_range, "rank long, id long").collect()} - {(0, 0)})

    pair_cuts = np.array([(rank << 32) + i for rank, i in cut_points("word", sizes)], dtype=U)

    def count_pairs(batches):
        words = Ranges(uri, "word", cuts, sizes)
        return _counted(batches, lambda data, offsets: [("pair", _pair_keys(words, data, offsets)[0])], {"pair": pair_cuts})

    def merge_pairs(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["bucket"].iloc[0])
        keys, counts = _merged_blocks(group)
        write_keys(f"{uri}/pair-{b}", keys, distinct)
        write_counts(f"{uri}/pair-count-{b}", counts)
        tails, before = np.unique(keys & LOW32, return_counts=True)
        out = [_blocks("before", tails, before, id_cuts).to_pandas(), _sum_row("pair", b, _sums(counts, len(keys)))]
        if order == 2:
            out.append(_heads(keys, counts, id_cuts))
        return pd.concat(out)[["bucket", "kind", "keys", "counts"]]

    def merge_words_again(group: pd.DataFrame) -> pd.DataFrame:
        """Per hash range: words' distinct predecessors, and what is known of them as contexts."""
        b = int(group["bucket"].iloc[0])
        if b < 0:
            return pd.DataFrame({"name": group["kind"], "text": [bytes(x).decode() for x in group["counts"]]})
        first, out = int(id_cuts[b - 1]) if b else 0, []
        for kind, width, dtype in (("before", 1, np.uint32), ("context", 4, np.int64)):
            mine = group[group["kind"] == kind]
            if len(mine):
                sums = np.zeros((sizes[b], width), np.int64)
                for keys, counts in zip(mine["keys"], mine["counts"]):
                    sums[unpack_keys(keys).astype(np.int64) - first] += unpack(counts, dtype).reshape(-1, width)
                for name, column in zip(("before",) if width == 1 else ("one", "two", "more", "total"), sums.T):
                    write_counts(f"{uri}/word-{name}-{b}", column)
                if kind == "before":
                    m = _kinds(sums[:, 0]).sum(axis=0).tolist()
                    out.append({"name": f"sums before {b}", "text": json.dumps([_of_counts(sums[:, 0]), m])})
        return pd.DataFrame(out, columns=["name", "text"])

    def collected(rows: DataFrame) -> dict[str, dict[int, list]]:
        """kind -> range -> what the range's merge has said."""
        got: dict[str, dict[int, list]] = {}
        for r in rows.collect():
            _, kind, b = r["name"].rsplit(" ", 2)
            got.setdefault(kind, {})[int(b)] = json.loads(r["text"])
        return got

    said = collected(texts.mapInArrow(count_pairs, BLOCK).groupBy("bucket").applyInPandas(merge_pairs, BLOCK).groupBy("bucket").applyInPandas(merge_words_again, "name string, text string"))
    free(spark)
    pair_sizes = [said["pair"][b][1] if b in said["pair"] else 0 for b in range(len(pair_cuts) + 1)]
    pairs = sum(pair_sizes)
    add = lambda rows: [sum(r[k] for r in rows) for k in range(4)]
    du = _discounts(add([x[0] for x in said["before"].values()]))
    gamma = sum(d * sum(x[1][k] for x in said["before"].values()) for k, d in enumerate(du)) / pairs
    model |= {"pair_cuts": pair_cuts.tolist(), "pair_sizes": pair_sizes, "pairs": pairs, "du": du, "gamma": gamma, "d": _discounts(add([x[0] for x in said["pair"].values()]))}
    if order == 2:
        return model

    groups = (pairs >> 32) + 1
    points = cut_points("pair", pair_sizes)
    triple_cuts = {f"triple{g}": np.array([((rank & 0xFFFFFFFF) << 32) + i for rank, i in points if rank >> 32 == g], dtype=U) for g in range(groups)}

    def count_triples(batches):
        words, own = Ranges(uri, "word", cuts, sizes), Ranges(uri, "pair", pair_cuts, pair_sizes, distinct)

        def keys(data, offsets):
            pair, ids, first = _pair_keys(words, data, offsets)
            some, back = np.unique(pair, return_inverse=True)
            ranks = own.find(some)[0][back]
            later = np.ones(len(ids), bool)
            later[first[:-1]] = False
            at = np.flatnonzero(later)
            prefix = ranks[at - 1]
            made = ((prefix.astype(U) & LOW32) << U(32)) | ids[at].astype(U)
            return [(f"triple{g}", made[prefix >> 32 == g] if groups > 1 else made) for g in range(groups)]

        return _counted(batches, keys, triple_cuts)

    def merge_triples(group: pd.DataFrame) -> pd.DataFrame:
        kind, b = group["kind"].iloc[0], int(group["bucket"].iloc[0])
        g, own = int(kind.removeprefix("triple")), Ranges(uri, "pair", pair_cuts, pair_sizes, distinct)
        keys, counts = _merged_blocks(group)
        write_keys(f"{uri}/{kind}-{b}", keys, distinct)
        write_counts(f"{uri}/{kind}-count-{b}", counts)
        heads, followers = merged(keys >> U(32), _kinds(counts))
        ranks = heads.astype(np.int64) + (g << 32)
        # A pair seen once has one follower seen once: only the others' are kept.
        often = own.counts("count", ranks, np.ones(len(ranks), bool)) > 1
        write_file(f"{uri}/{kind}-heads-{b}", [heads[often].astype(np.uint32).tobytes()])
        write_counts(f"{uri}/{kind}-followers-{b}", followers[often].ravel())
        middle = (own.key_of(ranks) & LOW32)[np.searchsorted(heads, keys >> U(32))]
        ends, times = np.unique((middle << U(32)) | (keys & LOW32), return_counts=True)
        out = [_blocks("ends", ends, times, pair_cuts).to_pandas(), _sum_row(kind, b, json.dumps([_of_counts(counts), len(keys), int(often.sum())]))]
        return pd.concat(out)[["bucket", "kind", "keys", "counts"]]

    def merge_ends(group: pd.DataFrame) -> pd.DataFrame:
        """Per pair range: in how many triples each pair is the end; a pair that begins a text keeps its count."""
        b = int(group["bucket"].iloc[0])
        if b < 0:
            return group[["bucket", "kind", "keys", "counts"]]
        own = Keys(f"{uri}/pair-{b}", distinct).all()
        times = np.zeros(len(own), np.int64)
        for keys, counts in zip(group["keys"], group["counts"]):
            times[np.searchsorted(own, unpack_keys(keys))] += unpack(counts, np.uint32)
        words = Ranges(uri, "word", cuts, sizes)
        starts = np.flatnonzero(own >> U(32) == U(words.find(np.array([BEGIN]))[0][0]))
        times[starts] = Counts(f"{uri}/pair-count-{b}").take(starts)
        write_counts(f"{uri}/pair-times-{b}", times)
        return pd.concat([_heads(own[times > 0], times[times > 0], id_cuts), _sum_row("times", b, _sums(times, len(own)))])[["bucket", "kind", "keys", "counts"]]

    # Pairs that begin a text may end no triple: every pair range takes part.
    every = spark.createDataFrame([(b, "ends", pack_keys(np.zeros(0, U)), pack(np.zeros(0, np.uint32))) for b, n in enumerate(pair_sizes) if n], BLOCK)
    merged_ = texts.mapInArrow(count_triples, BLOCK).groupBy("kind", "bucket").applyInPandas(merge_triples, BLOCK)
    said = collected(merged_.unionByName(every).groupBy("bucket").applyInPandas(merge_ends, BLOCK).groupBy("bucket").applyInPandas(merge_words_again, "name string, text string"))
    del merged_, every
    free(spark)
    model["d"] = _discounts(add([x[0] for x in said["times"].values()]))
    rows = {kind: said.get(kind, {}) for kind in triple_cuts}
    model["d3"] = _discounts(add([x[0] for r in rows.values() for x in r.values()]))
    model["triples"] = {kind: (c.tolist(), [rows[kind][b][1] if b in rows[kind] else 0 for b in range(len(c) + 1)], [rows[kind][b][2] if b in rows[kind] else 0 for b in range(len(c) + 1)]) for kind, c in triple_cuts.items()}
    return model


def _pair_keys(words: Ranges, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair key of every token with the one before it, ids, each text's first position)"""
    h, first = sequences(data, offsets)
    some, back = np.unique(np.append(h, BEGIN), return_inverse=True)
    ids = words.find(some)[0][back]
    return (contexts(ids[:-1], first, ids[-1]).astype(U) << U(32)) | ids[:-1].astype(U), ids[:-1], first


class Scorer:
    """Looks texts up in a trained model's mapped arrays."""

    def __init__(self, model: dict):
        self.m, uri, span = model, model["uri"], sum(model["sizes"])
        self.words = Ranges(uri, "word", hash_cuts(len(model["sizes"])), model["sizes"])
        if model["pairs"]:
            self.pairs = Ranges(uri, "pair", model["pair_cuts"], model["pair_sizes"], span)
        self.triples = [Ranges(uri, kind, cuts, sizes, span) for kind, (cuts, sizes, _) in model.get("triples", {}).items()]
        self.heads = [n for _, _, n in model.get("triples", {}).values()]
        self.followers: dict[tuple[int, int], tuple[np.ndarray, Counts]] = {}

    def _triple_counts(self, prefix: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prefix), np.float64)
        for g in np.unique(prefix >> 32).tolist():
            mine = prefix >> 32 == g
            ranks, known = self.triples[g].find(((prefix[mine].astype(U) & LOW32) << U(32)) | ids[mine].astype(U))
            out[mine] = self.triples[g].counts("count", ranks, known)
        return out

    def _kept(self, ranks: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """What the discounts leave to the lower order, of sorted known pairs with counts."""
        d = np.array(self.m["d3"])
        out = np.where(raw == 1, d[0], 0.0)
        for g in np.unique(ranks >> 32).tolist():
            often = np.flatnonzero((ranks >> 32 == g) & (raw > 1))
            own = ranks[often].astype(U) & LOW32
            cuts = self.triples[g].cuts
            # A frequent pair's followers may lie in several ranges; each has its share.
            low, high = np.searchsorted(cuts, own << U(32), "right"), np.searchsorted(cuts, (own << U(32)) | LOW32, "right")
            for step in range(int((high - low).max(initial=-1)) + 1):
                here = low + step
                there = np.flatnonzero(here <= high)
                for b, places in grouped(here[there]):
                    if not self.heads[g][b]:
                        continue
                    if (g, b) not in self.followers:
                        kind = self.triples[g].kind
                        self.followers[g, b] = map_file(f"{self.m['uri']}/{kind}-heads-{b}", np.uint32), Counts(f"{self.m['uri']}/{kind}-followers-{b}")
                    heads, counts = self.followers[g, b]
                    mine = there[places]
                    at = np.minimum(np.searchsorted(heads, own[mine].astype(np.uint32)), len(heads) - 1)
                    hit = heads[at] == own[mine]
                    for k in range(3):
                        out[often[mine[hit]]] += d[k] * counts.take(3 * at[hit] + k)
        return out / np.maximum(raw, 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        m = self.m
        h, first = sequences(data, offsets)
        some, back = np.unique(np.append(h, BEGIN), return_inverse=True)
        begin, back = back[-1], back[:-1]
        if m["pairs"]:
            ids, known = self.words.find(some)
            count, before, total = (self.words.counts(name, ids, known) for name in ("count", "before", "total"))
            d, du = np.array([0.0, *m["d"]]), np.array([0.0, *m["du"]])
            low = np.maximum(before - du[np.minimum(before, 3).astype(int)], 0) / m["pairs"] + m["gamma"] / (m["distinct"] + 1)
            left = sum(d[k + 1] * self.words.counts(name, ids, known) for k, name in enumerate(("one", "two", "more")))
            held = np.where(total > 0, left / np.maximum(total, 1), 1.0)
            ctx = contexts(back, first, begin)
            pair, pair_back = np.unique(ctx.astype(np.int64) * len(some) + back, return_inverse=True)
            a, b = pair // len(some), pair % len(some)
            both = known[a] & known[b]
            ranks, seen = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
            ranks[both], seen[both] = self.pairs.find((ids[a[both]].astype(U) << U(32)) | ids[b[both]].astype(U))
            c = self.pairs.counts("count" if m["order"] == 2 else "times", ranks, seen)
            p = np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / np.maximum(total[a], 1) + held[a] * low[b]
            logs = np.log10(p)[pair_back]
            later = np.ones(len(h), bool)
            later[first[:-1]] = False
            at = np.flatnonzero(later)
            if m["order"] == 3 and len(at):
                raw = self.pairs.counts("count", ranks, seen)
                keep = np.zeros(len(pair))
                keep[seen] = self._kept(ranks[seen], raw[seen])
                code = pair_back[at - 1].astype(np.int64) * len(some) + back[at]
                triple, where, triple_back = np.unique(code, return_index=True, return_inverse=True)
                x, w = triple // len(some), triple % len(some)
                use = seen[x] & known[w]
                d3, c3 = np.array([0.0, *m["d3"]]), np.zeros(len(triple))
                c3[use] = self._triple_counts(ranks[x[use]], ids[w[use]])
                lower = p[pair_back[at[where]]]
                p3 = np.where(raw[x] > 0, np.maximum(c3 - d3[np.minimum(c3, 3).astype(int)], 0) / np.maximum(raw[x], 1) + keep[x] * lower, lower)
                logs[at] = np.log10(p3)[triple_back]
        else:
            count, logs = np.zeros(len(some)), np.zeros(len(h))
        base = np.log10((count + 1) / (m["tokens"] + m["distinct"] + 1))[back]
        at = first[:-1]
        return np.diff(first), np.add.reduceat((count > 0)[back].astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: token counts, the add-one base score and the model's log10 probability of the text."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(model)
            for at, data, offsets in slices(batch.column(1), 4 << 20):
                n, known, base, score = scorer.score(data, offsets)
                yield pa.record_batch([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model["tokens"]), pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORES)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))

"""Benchmark decontamination: n-gram seeds join training passages to test items; Smith-Waterman scores them.

 1. The items' word n-grams are the seeds. One pass over all documents counts in how many documents each seed stands.
 2. A seed is rare if it stands in at most RARE_SHARE of the documents, or in no more than the median of its own
    item's seeds.
 3. A second pass joins documents to items on all seeds. Around each run of seeds on neighbouring diagonals, the
    item is aligned with the document's words (match 1, mismatch and gap -1). A pair is reported if the best
    alignment reaches MIN_SCORE of the score of an exact copy.

A rare seed is evidence enough for an alignment. A pair that has common seeds only (an edited copy in many documents
keeps no others) is aligned unless too few of the item's words stand in the window for MIN_SCORE: an alignment has no
more matches than that, so the test loses no pair.

The items are sent to the workers in parts of at most ITEM_WORDS words, each with its own passes, so what is sent is
bounded however many items there are. No document's words are shuffled.

Defined results: items or documents with fewer than n words, null and empty ones, match nothing; the same item or
document twice is reported for each; a document that has several items has a row for each; other columns are not
looked at. Words are runs of letters and digits, lower-cased in A-Z and in the Latin-1 letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, U, Words, ngrams, slices, split_words
from .shared import session

SEED, RARE_SHARE, MIN_SCORE = 3, 0.0005, 0.5
ITEM_WORDS = 2_000_000
#: Seed places that are looked at together (a document's are never parted).
PLACES = 1_000_000
LEAKS = "doc_id long, item_id long, score double, alignment int, item_words int, first_word long, last_word long"


def lowered(data: np.ndarray) -> np.ndarray:
    """Latin-1 capitals with accents in lower case (A-Z are left to split_words)."""
    hit = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    if len(hit):
        data = data.copy()
        data[hit + 1] += 0x20
    return data


def doc_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return split_words(lowered(data), offsets, ALNUM)


class Seeds:
    """The items' words and the places of each distinct seed, with a bit table that most n-grams fail."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int):
        words = next(((doc_words(d, o)) for _, d, o in slices(pa.array(texts, pa.string()), 1 << 62)), None)
        self.n, self.ids = n, np.array(ids, dtype=np.int64)
        self.items = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])]
        grams, at = ngrams(words, n)
        item = words.text_of[at]
        self.hashes, number = np.unique(grams, return_inverse=True)
        self._place(number, item, at - words.first[item])

    def _place(self, number: np.ndarray, item: np.ndarray, pos: np.ndarray) -> None:
        order = np.argsort(number, kind="stable")
        self.number, self.item, self.pos = number[order], item[order], pos[order]
        self.edge = np.searchsorted(self.number, np.arange(len(self.hashes) + 1))
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.hashes & U((1 << 20) - 1)).astype(np.int64)] = True

    def mark_rare(self, counts: np.ndarray, documents: int, share: float) -> None:
        """Mark the places of seeds that are rare by share or within their item."""
        own = counts[self.number]
        limit = np.full(len(self.items), share * documents)
        order = np.lexsort((own, self.item))
        edges = np.searchsorted(self.item[order], np.arange(len(self.items) + 1))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                limit[k] = max(limit[k], own[order[(a + b - 1) // 2]])
        self.rare = own <= limit[self.item]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(seed number, index of its first word) of all seeds in the texts."""
        grams, at = ngrams(words, self.n)
        maybe = np.flatnonzero(self.table[(grams & U((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.hashes, grams[maybe]), len(self.hashes) - 1)
        sure = self.hashes[number] == grams[maybe]
        return number[sure], at[maybe[sure]]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end in the text) with match 1, mismatch -1, gap -1; one vector step for each item word."""
    slope = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
    for w in item:
        t = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(text == w, 1, -1), 0, out=t[1:])
        np.maximum(t, row - 1, out=t)
        row = np.maximum.accumulate(t + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _align(item: np.ndarray, text: np.ndarray, starts: np.ndarray, least: float = 0) -> tuple[int, int, int]:
    """Best (score, first word, end) over the windows around the diagonals on which seeds lie. Windows with fewer than
    `least` of the item's words are passed over: an alignment there scores less."""
    size = len(item)
    slack = size // 2 + 2
    starts = np.unique(starts)
    runs = np.split(starts, np.flatnonzero(np.diff(starts) > slack) + 1)
    best = (0, 0, 0)
    for run in runs:
        # A long run is cut into windows that overlap by more than an item, so that none is without bound.
        for lo in range(int(run[0]) - slack, int(run[-1]) + 1, 4 * size + 64):
            a, b = max(0, lo), min(len(text), lo + 6 * size + 64 + 2 * slack)
            if b <= a or (least and np.isin(item, text[a:b]).sum() < least):
                continue
            score, end = smith_waterman(item, text[a:b])
            if score > best[0]:
                _, length = smith_waterman(item[::-1], text[a : a + end][::-1])
                best = (score, a + end - length, a + end)
            if best[0] == size:
                return best
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = SEED, min_score: float = MIN_SCORE, rare_share: float = RARE_SHARE, item_words: int = ITEM_WORDS) -> DataFrame:
    """One row per document and item that the document has a copy of."""
    spark = session(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("length(text) > 0")
    # A word takes two bytes at least, its separator included.
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // (2 * item_words)))
    out = None
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        found = _part(docs, mine.collect(), n, min_score, rare_share)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def _part(docs: DataFrame, items: list, n: int, min_score: float, share: float) -> DataFrame | None:
    if not items:
        return None
    seeds = Seeds([r["item_id"] for r in items], [r["text"] for r in items], n)
    if not len(seeds.hashes):
        return None
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        counts, documents = np.zeros(len(s.hashes) + 1, np.int64), 0
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                words = doc_words(data, offsets)
                number, at = s.hits(words)
                pairs = np.unique(words.text_of[at] * (len(s.hashes) + 1) + number)
                counts += np.bincount(pairs % (len(s.hashes) + 1), minlength=len(s.hashes) + 1)
                documents += len(offsets) - 1
        counts[-1] = documents
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], ["seed", "n"])

    counts = np.zeros(len(seeds.hashes) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        counts[r["seed"]] = r["n"]
    rare = Seeds.__new__(Seeds)
    rare.__dict__.update(seeds.__dict__)
    rare.mark_rare(counts[:-1], int(counts[-1]), share)
    sent_rare = spark.sparkContext.broadcast(rare)

    def rows_of(s: Seeds, words: Words, number: np.ndarray, at: np.ndarray, at0: int) -> list[tuple]:
        times = s.edge[number + 1] - s.edge[number]
        place = np.repeat(s.edge[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        text = words.text_of[np.repeat(at, times)]
        item, known = s.item[place], s.rare[place]
        start = np.repeat(at, times) - words.first[text] - s.pos[place]
        order = np.lexsort((start, item, text))
        text, item, start, known = text[order], item[order], start[order], known[order]
        new = np.flatnonzero(np.diff(text * len(s.items) + item, prepend=-1))
        rows = []
        for a, b in zip(new, np.append(new[1:], len(text))):
            own = s.items[item[a]]
            least = 0 if known[a:b].any() else min_score * len(own)
            score, first, end = _align(own, words.hash[words.first[text[a]] : words.first[text[a] + 1]], start[a:b], least)
            if score >= min_score * len(own):
                rows.append((at0 + int(text[a]), int(s.ids[item[a]]), score / len(own), score, len(own), first, end - 1))
        return rows

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent_rare.value
        for batch in batches:
            for at0, data, offsets in slices(batch.column(1)):
                words = doc_words(data, offsets)
                number, at = s.hits(words)
                if not len(number):
                    continue
                times = s.edge[number + 1] - s.edge[number]
                total, of = np.cumsum(times), words.text_of[at]
                block = (total - times)[np.searchsorted(of, of)] // PLACES
                edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
                rows = []
                for x, y in zip(edges, edges[1:]):
                    rows += rows_of(s, words, number[x:y], at[x:y], at0)
                if rows:
                    c = list(zip(*rows))
                    yield pa.record_batch([batch.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int64()), pa.array(c[6], pa.int64())], [x.split()[0] for x in LEAKS.split(", ")])

    return docs.mapInArrow(match, LEAKS)

"""Words of whole Arrow batches as numpy arrays: one pass over the bytes, no Python object per word.

A word is a maximal run of bytes of one class; texts never share a word. A word's hash is a polynomial over
random byte codes, modulo 2**64, then mixed. Equal words have equal hashes in every process.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
#: Bytes that one numpy pass takes at most, unless a single text is longer.
SLICE = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


CODES = mix(np.arange(1, 257, dtype=U))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(size, _R, dtype=U)), np.cumprod(np.full(size, _R_INVERSE, dtype=U))


@dataclass
class Words:
    """start, end: byte positions; hash; first: index of each text's first word, with the total at its end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the texts' offsets (with the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE):
    """(index of the first text, bytes, offsets) of runs of texts of about `size` bytes."""
    data, offsets = texts_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < n]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if len(s):
        size = 1 << max(16, int(n - 1).bit_length())
        powers, inverse = _powers(size)
        with np.errstate(over="ignore"):
            v = CODES[data]
            v[~inside] = 0
            v *= powers[:n]
            h = mix(np.add.reduceat(v, s) * inverse[s])
    else:
        h = np.zeros(0, U)
    return Words(data, s, e, h, np.searchsorted(s, offsets))


def word_hash(word: str) -> int:
    """The hash that split_words gives to this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    every = np.ones(256, dtype=bool)
    return int(split_words(data, np.array([0, len(data)]), every, lower=False).hash[0])


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and the index of each run's first word."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    text = words.text_of
    at = np.flatnonzero(text[: total - n + 1] == text[n - 1 :])
    with np.errstate(over="ignore"):
        h = words.hash[at].copy()
        for k in range(1, n):
            h = mix(h * U(0x9FB21C651E98DF25) + U(k)) ^ words.hash[at + k] * U(0xD6E8FEB86659FD93)
        return mix(h), at

"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last bytes meets a pattern, so copies and shared passages give the same
chunks wherever they stand. A chunk is encoded once per worker process and kept in a bounded memo that all tasks of the
process share. Then the joins are repaired by encoding again what straddles each cut until it agrees exactly with the
chunks on both sides. Two tokenizer families are told apart by the vocabulary file, and any other is refused:

 - Word vocabularies (lower-cased, pieces end in a mark, white space dropped): tokens never span a blank, so a
   straddling piece agrees where it meets a blank on either side; where a chunk has no blank it grows over further
   chunks. What the memo lacks is encoded word by word from a second memo, so that only unseen words reach the tokenizer.
 - Byte-level vocabularies (no normaliser, pieces found by scanning from left to right): the straddling window starts at
   a piece that is known to be right and grows until one of its pieces starts where one of the next chunk's own pieces
   does. From there on both scans are at one place and read one text, so they agree to the chunk's end.

Defined results: a null text is read as empty, and an empty text has no tokens; special token strings in a text get
their special ids as the tokenizers library gives them; every row gives one row, repeated rows too; an empty table
gives none; columns other than the two named are not looked at. The vocabulary file is a parameter and has to be
readable on every worker (it is part of an installed package here).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import CODES, U
from .shared import session

SCHEMA = "doc_id long, n_tokens long, ids_text string, decoded string"
#: Mean bytes of a chunk (a power of two), bytes that the rolling hash sees, and entries that a memo may hold.
MEAN_CHUNK, WINDOW, MEMO = 256, 16, 150_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Byte positions after which a chunk ends: where the hash of the last WINDOW bytes is 0 modulo `mean`. Never
    inside a character."""
    a = np.frombuffer(data, dtype=np.uint8)
    if len(a) <= WINDOW:
        return [len(a)]
    with np.errstate(over="ignore"):
        total = np.cumsum(CODES[a], dtype=U)
        rolled = total[WINDOW:] - total[:-WINDOW]
        found = np.flatnonzero(((rolled * U(0x9E3779B97F4A7C15)) >> U(40)) % U(mean) == 0) + WINDOW + 1
    found = found[found < len(a)]
    found = found[(a[found] & 0xC0) != 0x80]
    return [*found.tolist(), len(a)]


# Fixed value: how word vocabularies find pieces.
WORD_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words of these characters alone are lower-cased and cut here; all others go through the whole tokenizer.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def family(path: str) -> str:
    """`word` or `byte`, by what the vocabulary file says of normalising and finding pieces; a ValueError for others."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    kinds = lambda x, parts: [p["type"] for p in x.get(parts, [x])] if x else []
    normal, pieces, model = kinds(found.get("normalizer"), "normalizers"), kinds(found.get("pre_tokenizer"), "pretokenizers"), found["model"]
    if model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix"):
        if normal == ["NFC", "Replace", "Lowercase"] and pieces == ["Split", "ByteLevel"] and model.get("end_of_word_suffix") and found.get("decoder") is None:
            if found["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORD_PIECES}:
                return "word"
        if not normal and pieces == ["ByteLevel"] and found["pre_tokenizer"].get("use_regex") and not found["pre_tokenizer"].get("add_prefix_space") and not model.get("end_of_word_suffix"):
            return "byte"
    raise ValueError(f"{path}: a tokenizer of another kind; chunks could not be joined exactly")


def loaded(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def encoder(path: str, mean: int = MEAN_CHUNK) -> Encoder | ByteEncoder:
    """The process's one encoder of a vocabulary: its memos are shared by all tasks that the process runs."""
    return {"word": Encoder, "byte": ByteEncoder}[family(path)](path, mean)


class ByteEncoder:
    """Encodes texts with byte-level vocabularies to (number of ids, ids in decimal joined by spaces, decoded text)."""

    def __init__(self, path: str, mean: int = MEAN_CHUNK, memo: int = MEMO):
        self.tokenizer, self.mean, self.limit = loaded(path), mean, memo
        self.scan, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, list[tuple[int, str]]] = {}
        self.ids: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[tuple[int, str]]:
        """(start, piece) of a text by itself."""
        return [(at[0], piece) for piece, at in self.scan(text)]

    def chunk(self, text: str) -> list[tuple[int, str]]:
        if text not in self.chunks:
            if len(self.chunks) > self.limit // 16:
                self.chunks.clear()
            self.chunks[text] = self.pieces(text)
        return self.chunks[text]

    def whole(self, text: str) -> list[str]:
        """The pieces of the whole text, from its chunks' pieces and repaired joins."""
        data, edges, at = text.encode("utf-8", "surrogatepass"), [0], 0
        for to in cuts(data, self.mean):
            edges.append(edges[-1] + len(data[at:to].decode("utf-8", "surrogatepass")))
            at = to
        done: list[tuple[int, str]] = []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            own = [(a + s, p) for s, p in self.chunk(text[a:b])]
            done = self.joined(text, done, own, a, edges[k + 1 :]) if k else own
        return [p for _, p in done]

    def joined(self, text: str, done: list[tuple[int, str]], own: list[tuple[int, str]], cut: int, ends: list[int]) -> list[tuple[int, str]]:
        """Right pieces up to the cut and a chunk's own ones, made right. A scan decides on a piece by what follows it, so
        the last pieces before the cut are not known to be right: the window starts at the third but last."""
        keep = max(0, len(done) - 3)
        start = done[keep][0] if done else 0
        starts = {s: n for n, (s, _) in enumerate(own)}
        reach = 16
        while True:
            stop = min(cut + reach, ends[0])
            window = [(start + s, p) for s, p in self.pieces(text[start:stop])]
            # Of the window's last pieces the same is true, unless it ends where the chunk does.
            sure = window if stop == ends[0] else window[:-3]
            for n, (s, _) in enumerate(sure):
                if s >= cut and s in starts:
                    return done[:keep] + window[:n] + own[starts[s] :]
            if stop == ends[0]:
                return done[:keep] + window
            reach *= 4

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        out = []
        if len(self.ids) > self.limit:
            self.ids.clear()
        for text in texts:
            if any(x in text for x in self.specials):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = []
                for piece in self.whole(text):
                    if piece not in self.ids:
                        self.ids[piece] = [t.id for t in self.model.tokenize(piece)]
                    ids += self.ids[piece]
            out.append((len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)))
        return out


class Encoder:
    """Encodes texts with word vocabularies to (number of ids, ids in decimal joined by spaces, decoded text)."""

    def __init__(self, path: str, mean: int = MEAN_CHUNK, memo: int = MEMO):
        if family(path) != "word":
            raise ValueError(f"{path} is not a word vocabulary")
        self.tokenizer = loaded(path)
        self.mean, self.limit = mean, memo
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self._forget()

    def _forget(self) -> None:
        #: word to its ids and to its decoding; the empty word has neither
        self.ids: dict[str, str] = {"": ""}
        self.decoded: dict[str, str] = {"": ""}
        self.pretokens: dict[str, tuple[str, str]] = {}
        self.insides: dict[str, tuple[str, str]] = {}

    def _learn(self, word: str) -> None:
        if _PLAIN.fullmatch(word) and not ("<" in word and any(x in word for x in self.specials)):
            pieces = _PRETOKEN.findall(word.lower())
            for piece in pieces:
                if piece not in self.pretokens:
                    plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                    ids = [t.id for t in self.tokenizer.model.tokenize(plain)]
                    self.pretokens[piece] = " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))
            if len(pieces) == 1:
                self.ids[word], self.decoded[word] = self.pretokens[pieces[0]]
            else:
                found = [self.pretokens[p] for p in pieces]
                self.ids[word], self.decoded[word] = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            self.ids[word], self.decoded[word] = " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _words(self, words: list[str]) -> tuple[str, str]:
        return " ".join(filter(None, map(self.ids.__getitem__, words))), " ".join(filter(None, map(self.decoded.__getitem__, words)))

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """(is a chunk's inside, string) in order; together they are the text, cut at blanks only."""
        data = text.encode("utf-8", "surrogatepass")
        text = text.replace("\n", " ")
        out, pending, at, place = [], 0, 0, 0
        ascii_only = len(data) == len(text)
        for to in cuts(data, self.mean):
            stop = to if ascii_only else place + len(data[at:to].decode("utf-8", "surrogatepass"))
            first = text.find(" ", place, stop)
            if first >= 0:
                last = text.rfind(" ", place, stop)
                out.append((False, text[pending:first]))
                out.append((True, text[first:last]))
                pending = last
            at, place = to, stop
        out.append((False, text[pending:]))
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        if len(self.ids) > self.limit:
            self._forget()
        if len(self.insides) > self.limit // 16:
            self.insides.clear()
        work, new = [], set()
        for text in texts:
            parts: list = []
            for inside, s in self.pieces(text):
                found = self.insides.get(s) if inside else None
                if found is None:
                    words = s.split(" ")
                    new.update(words)
                    parts.append((s if inside else None, words))
                else:
                    parts.append((None, found))
            work.append(parts)
        for word in new.difference(self.ids):
            self._learn(word)
        out = []
        for parts in work:
            ids, decoded = [], []
            for s, x in parts:
                if type(x) is list:
                    x = self._words(x)
                    if s is not None:
                        self.insides[s] = x
                ids.append(x[0])
                decoded.append(x[1])
            joined = " ".join(filter(None, ids))
            out.append((joined.count(" ") + 1 if joined else 0, joined, " ".join(filter(None, decoded))))
        return out


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_text, decoded): the decimal ids joined by spaces, and their decoding. No shuffle."""
    session(docs)
    path = path or vocabulary()
    family(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and (not some or size < 1 << 20):
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                got = own.encode(some)
                yield pa.record_batch([batch.column(0).slice(at, len(some)), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "n_tokens", "ids_text", "decoded"])
                at += len(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the two digests of the ids and of the decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def brute_force(texts: list[str | None], path: str | None = None) -> list[tuple[int, str, str]]:
    """The same digests by encoding each whole text at once; for tests."""
    t = loaded(path or vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out

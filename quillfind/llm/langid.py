"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time and labels every byte; a document's probabilities are
the mean of its bytes' probabilities. Texts are cut into windows of WINDOW bytes, which run side by side as one matrix
and start from a zero state in either direction; every byte of every text takes part. Gates and candidates are
piecewise linear (clipped), so a step is a small matrix product and a few vector operations.

Learning uses at most SAMPLE documents (the smallest hashes of their ids) and PIECES windows of each, a bound that
does not grow with the data. Scoring covers whole texts and shuffles nothing.

Defined results: a null text, or one without a letter, gets `und` with score 0; with nothing to learn from, so does
every text; documents with null lang are not learned from; repeated rows give repeated results; ids, source and lang
are never inputs of a prediction; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import slices, texts_bytes
from .shared import session

SAMPLE, PIECES, WINDOW, HIDDEN = 4000, 6, 64, 8
STEPS, BATCH, RATE, SEED = 500, 256, 0.02, 7
UNKNOWN = "und"
#: Windows that run side by side when scoring.
LANES = 4096


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


@dataclass
class Network:
    """wx: per direction, each byte's part of the two gates and the candidate (3H x 256); wh: the state's part
    (3H x H); out: labels x 2H; bias: labels."""

    languages: list[str]
    wx: list[np.ndarray]
    wh: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        w = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
        return cls(languages, [w(3 * hidden, 256, by=0.3) for _ in (0, 1)], [w(3 * hidden, hidden, by=0.3) for _ in (0, 1)], w(len(languages), 2 * hidden, by=0.3), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, self.out, self.bias]

    def _run(self, d: int, x: np.ndarray, states: np.ndarray, tape: list | None = None) -> None:
        """Write one direction's states (T, H, B) for byte columns x (T, B)."""
        wx, wh, hid = self.wx[d], self.wh[d], self.wh[d].shape[1]
        h = np.zeros((hid, x.shape[1]), np.float32)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            a, b = np.take(wx, x[t], axis=1), wh @ h
            zr = a[: 2 * hid]
            zr += b[: 2 * hid]
            zr *= 0.25
            zr += 0.5
            np.clip(zr, 0, 1, out=zr)
            z, r = zr[:hid], zr[hid:]
            n = r * b[2 * hid :]
            n += a[2 * hid :]
            np.clip(n, -1, 1, out=n)
            if tape is not None:
                tape.append((t, h, z, r, n, b[2 * hid :]))
            h = h - n
            h *= z
            h += n
            states[t] = h

    def probabilities(self, x: np.ndarray, tapes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(T, labels, B) probabilities of every byte, and the states (T, 2H, B)."""
        hid = self.wh[0].shape[1]
        states = np.empty((len(x), 2 * hid, x.shape[1]), np.float32)
        for d in (0, 1):
            self._run(d, x, states[:, d * hid : (d + 1) * hid], None if tapes is None else tapes[d])
        logits = np.matmul(self.out, states)
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, states

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradient by backpropagation through time."""
        tapes: list[list] = [[], []]
        p, states = self.probabilities(x, tapes)
        lanes = np.arange(x.shape[1])
        loss = float(-np.log(p[:, y, lanes] + 1e-9).mean())
        p[:, y, lanes] -= 1
        p /= p.shape[0] * p.shape[2]
        g_out, g_bias = np.einsum("tlb,thb->lh", p, states), p.sum(axis=(0, 2))
        back = np.matmul(self.out.T, p)
        grads = []
        hid = self.wh[0].shape[1]
        for d in (0, 1):
            g_wx, g_wh, carry = np.zeros_like(self.wx[d]), np.zeros_like(self.wh[d]), np.zeros((hid, x.shape[1]), np.float32)
            for t, h, z, r, n, b in reversed(tapes[d]):
                g = back[t, d * hid : (d + 1) * hid] + carry
                gn = g * (1 - z) * (np.abs(n) < 1)
                gz = g * (h - n) * 0.25 * ((z > 0) & (z < 1))
                gr = gn * b * 0.25 * ((r > 0) & (r < 1))
                ga = np.concatenate([gz, gr, gn])
                gb = np.concatenate([gz, gr, gn * r])
                g_wh += gb @ h.T
                np.add.at(g_wx.T, x[t], ga.T)
                carry = g * z + self.wh[d].T @ gb
            grads.append((g_wx, g_wh))
        return loss, [grads[0][0], grads[1][0], grads[0][1], grads[1][1], g_out, g_bias]


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """Train on byte windows (n, T) and their labels' numbers, with Adam and a decaying rate."""
    net, r = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    m, v = [[np.zeros_like(p) for p in net.parameters()] for _ in (0, 1)]
    for step in range(1, steps + 1):
        pick = r.integers(0, len(windows), batch)
        _, grads = net.gradients(np.ascontiguousarray(windows[pick].T), labels[pick])
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        now = rate * (1 - step / (steps + 1)) * min(1.0, step / 20)
        for p, g, a, b in zip(net.parameters(), grads, m, v):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= (now * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Learn from texts and languages of the given documents."""
    session(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null and text <> '' and doc_id is not null")
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_bytes(batch.column(1))
            ids, langs, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for k, i in enumerate(ids):
                text, r = data[offsets[k] : offsets[k + 1]], np.random.default_rng(abs(i))
                for at in sorted(set(r.integers(0, max(1, len(text) - WINDOW + 1), PIECES).tolist())):
                    piece = text[at : at + WINDOW].tobytes()
                    out.append((i, langs[k], piece + b" " * (WINDOW - len(piece))))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())], ["doc_id", "lang", "piece"])

    # Ids that several rows share could bring more rows than ids: the bound holds for the windows too.
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, piece binary").limit(sample * PIECES).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["doc_id"], bytes(r["piece"]), r["lang"]))
    languages = sorted({r["lang"] for r in got})
    number = {x: k for k, x in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r["piece"]) for r in got), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([number[r["lang"]] for r in got]), languages)


class Labeler:
    def __init__(self, net: Network):
        self.net = net

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, labels): mean probabilities over each text's bytes; zeros for empty texts."""
        sizes = np.diff(offsets)
        count = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][owner] + nth * WINDOW
        length = np.minimum(WINDOW, offsets[1:][owner] - start)
        padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
        total = np.zeros((len(sizes), len(self.net.languages)))
        for a in range(0, len(start), LANES):
            s, n, o = start[a : a + LANES], length[a : a + LANES], owner[a : a + LANES]
            x = padded[s[None, :] + np.arange(WINDOW)[:, None]]
            live = np.arange(WINDOW)[:, None] < n[None, :]
            x[~live] = 32
            p, _ = self.net.probabilities(x)
            if not live.all():
                p *= live[:, None, :]
            np.add.at(total, o, p.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def label_documents(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    session(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(text_col).cast("string").rlike(r"\p{L}"), F.col(text_col).cast("string")).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler, names = Labeler(net), np.array([*net.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                p = labeler.pooled(data, offsets)
                best = np.where(np.diff(offsets) > 0, p.argmax(axis=1), len(net.languages))
                yield pa.record_batch([batch.column(0).slice(at, len(p)), pa.array(names[best], pa.string()), pa.array(np.clip(p.max(axis=1), 0, 1))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

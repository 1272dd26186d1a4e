"""Counterfactual-regularised toxicity classifier.

A logistic regression over the presence of selected words and word beginnings. Features are found by a Spark count
over the labelled rows: those that stand in toxic texts far more often than in others (by the log-likelihood
ratio). Identity terms are features as well. For every labelled text with an identity term, the term is swapped in the
text for others of its kind: the text without the term's words gives the features that stay, and to these come all
features of the one term or of the other. Training penalises the squared difference of the two whole texts' scores, so
a mention of a group by itself does not change the verdict. Terms are also placed into a bounded number of texts that
may name no group, so that the penalty is never empty.

Learning uses at most SAMPLE labelled rows (the smallest hashes of their ids), a bound that does not grow with the
data, and SWAPS swaps of every identity term in each; scoring covers every row and whole texts, and shuffles nothing.

Defined results: null, empty and wordless texts get the score of a text without features; with no usable labels the
score is 0 for all; rows whose label is null are not learned from; a document that is labelled twice counts twice;
labels, lang, source and ids are never inputs of a score; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, CODES, LOWER, U, _powers, mix, slices, split_words, word_hash
from .decontam import lowered
from .shared import session

SAMPLE, FEATURES, MIN_TOXIC, MIN_Z = 30_000, 1000, 4, 5.5
PENALTY, RIDGE, STEPS, INJECTED, SWAPS = 4.0, 0.02, 400, 200, 4
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

# Identity terms by kind. Terms of one kind are swapped for each other.
IDENTITY = {
    "gender": "women men woman man girls boys girl boy female male nonbinary transgender",
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists catholic atheist",
    "origin": "african asian european american mexican chinese indian arab immigrant immigrants refugee refugees",
    "colour": "black white brown latino latina hispanic",
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual",
    "age": "elderly old young teenage children",
    "ability": "disabled deaf blind autistic",
    "frauen": "frauen männer juden muslime christen ausländer flüchtlinge",
    "femmes": "femmes hommes juifs musulmans chrétiens étrangers réfugiés",
    "mujeres": "mujeres hombres judíos musulmanes cristianos extranjeros refugiados",
}


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    counterfactual_gap: float = 0.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of all words and word beginnings, repeats included."""
    return _features(data, offsets)[:2]


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature hash, hash of the word that has it)."""
    data = lowered(data)
    words = split_words(data, offsets, ALNUM)
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    low, (powers, inverse) = LOWER[data], _powers(1 << max(16, int(len(data) - 1).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(CODES[low] * powers[: len(data)], out=total[1:])
        text, texts, hashes, of = words.text_of, [words.text_of], [words.hash], [words.hash]
        length = words.end - words.start
        for k in PREFIXES:
            use = np.flatnonzero(length > k)
            s = words.start[use]
            hashes.append(mix((total[s + k] - total[s]) * inverse[s] + U(k)))
            texts.append(text[use])
            of.append(words.hash[use])
    return np.concatenate(texts), np.concatenate(hashes), np.concatenate(of)


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text, h = features(data, offsets)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def identity_terms(groups: dict[str, str] = IDENTITY) -> dict[int, list[int]]:
    """Each term's hash to the hashes of the others of its kind."""
    out = {}
    for terms in groups.values():
        hashes = [word_hash(t) for t in terms.split()]
        for h in hashes:
            out[h] = [x for x in hashes if x != h]
    return out


def term_features(groups: dict[str, str] = IDENTITY) -> dict[int, list[int]]:
    """Each term's hash to the hashes of all its features: the word and its beginnings."""
    out = {}
    for term in " ".join(groups.values()).split():
        data = np.frombuffer(term.encode(), np.uint8)
        out[word_hash(term)] = _distinct(data, np.array([0, len(data)]))[1].tolist()
    return out


def _count(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many toxic and other texts each feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, data, offsets in slices(batch.column(0)):
                text, h = _distinct(data, offsets)
                if len(h):
                    some, back = np.unique(h, return_inverse=True)
                    toxic = np.bincount(back, weights=label[at + text], minlength=len(some)).astype(np.int64)
                    yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(toxic), pa.array(np.bincount(back) - toxic)], ["feature", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents (all rows of `labels`, of which at most `sample` are used)."""
    session(docs)
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    empty = Model(np.zeros(0, U), np.zeros(0), -np.inf)
    if not n1 or not n0:
        return empty
    # Signed root of the log-likelihood ratio: sound for small counts, where a z-score of log odds is not.
    term = lambda o, e: f"case when {o} > 0 then {o} * ln({o} / ({e})) else 0 end"
    rate = f"((toxic + clean) / {n1 + n0})"
    cells = [term("toxic", f"{n1} * {rate}"), term("clean", f"{n0} * {rate}"), term(f"({n1} - toxic)", f"{n1} * (1 - {rate})"), term(f"({n0} - clean)", f"{n0} * (1 - {rate})")]
    z = F.expr(f"sqrt(greatest(2 * ({' + '.join(cells)}), 0)) * sign(toxic / {n1} - clean / {n0})")
    best = _count(rows).filter(F.col("toxic") >= MIN_TOXIC).withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    swaps = identity_terms()
    terms = np.array(sorted(swaps), dtype=U)
    hashes = np.unique(np.concatenate([np.array([r["feature"] for r in best], dtype=np.int64).astype(U), terms]))

    def selected(text: np.ndarray, h: np.ndarray, n: int) -> list[list[int]]:
        """Each text's distinct selected features, by number."""
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[k] == h
        found: list[list[int]] = [[] for _ in range(n)]
        for pair in np.unique(text[hit] * len(hashes) + k[hit]).tolist():
            found[pair // len(hashes)].append(pair % len(hashes))
        return found

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with its features, and one per text and identity term in it: what stays without the term."""
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                text, h, word = _features(data, offsets)
                n = len(offsets) - 1
                label = batch.column(2).slice(at, n).cast(pa.int32()).to_pylist()
                out = [(y, f, -1) for y, f in zip(label, selected(text, h, n))]
                named = np.isin(word, terms)
                for pair in np.unique(text[named] * len(terms) + np.searchsorted(terms, word[named])).tolist():
                    t, k = divmod(pair, len(terms))
                    stay = (text == t) & (word != terms[k])
                    out.append((label[t], selected(text[stay] * 0, h[stay], 1)[0], k))
                toxic, found, term = zip(*out)
                yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(term, pa.int32())], ["toxic", "found", "term"])

    # Equal feature sets with equal labels are one weighted row: mostly the texts without any feature.
    grouped = rows.select("doc_id", "text", "toxic").mapInArrow(present, "toxic int, found array<int>, term int").groupBy("toxic", "found", "term").agg(F.count("*").alias("n")).orderBy("toxic", "term", "found").collect()
    texts_ = [(list(r["found"]), r["toxic"], r["n"]) for r in grouped if r["term"] < 0]
    named = [(list(r["found"]), int(terms[r["term"]]), r["n"]) for r in grouped if r["term"] >= 0]
    return _fit(hashes, texts_, named, swaps)


class _Sets:
    """Feature sets whose logits are taken together: one entry per set and feature."""

    def __init__(self, sets: list[set[int]]):
        self.n = len(sets)
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.feature = np.array([f for s in sets for f in sorted(s)], dtype=np.int64)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.feature], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, weights=g[self.row], minlength=size)


def _fit(hashes: np.ndarray, rows: list[tuple[list[int], int, int]], named: list[tuple[list[int], int, int]], swaps: dict[int, list[int]]) -> Model:
    """rows: (features, label, number of texts); named: (features without the term, term, number of texts)."""
    index = {int(h): k for k, h in enumerate(hashes)}
    own = {h: {index[f] for f in every if f in index} for h, every in term_features().items()}
    y, n = np.array([r[1] for r in rows], dtype=np.float64), np.array([r[2] for r in rows], dtype=np.float64)
    x = _Sets([set(r[0]) for r in rows])
    # Counterfactual pairs: a text with a term, and the text with another term in its place. Pairs from texts that have
    # a term, and from texts that one is placed into, have equal weight together.
    pairs, every = [], list(swaps)
    for i, (stay, term, times) in enumerate(named):
        others = swaps[term]
        pairs += [({*stay, *own[term]}, {*stay, *own[others[(i + j) % len(others)]]}, times) for j in range(min(SWAPS, len(others)))]
    found = len(pairs)
    for k in range(min(INJECTED, len(rows) * 4)):
        stay, term = rows[k * 7919 % len(rows)][0], every[k % len(every)]
        pairs.append(({*stay, *own[term]}, {*stay, *own[swaps[term][k % len(swaps[term])]]}, 1))
    one, two, weight = _Sets([p[0] for p in pairs]), _Sets([p[1] for p in pairs]), np.array([p[2] for p in pairs], dtype=np.float64)
    for part in (weight[:found], weight[found:]):
        part /= max(part.sum(), 1) * (2 if found else 1)
    size, total = len(hashes), n.sum()
    w, b = np.zeros(size), float(np.log(n[y == 1].sum() / n[y == 0].sum()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    gap = 0.0
    for step in range(1, STEPS + 1):
        g = n * (sigmoid(x.logits(w) + b) - y) / total
        grad = np.append(x.back(g, size) + RIDGE * w / size, g.sum())
        a, c = sigmoid(one.logits(w) + b), sigmoid(two.logits(w) + b)
        diff = (a - c) * weight
        grad[:-1] += 2 * PENALTY * (one.back(diff * a * (1 - a), size) - two.back(diff * c * (1 - c), size))
        gap = float(np.abs(diff).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(hashes, w, float(b), gap)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (and the columns in `keep`) with the score between 0 and 1, for every row."""
    session(docs)
    table = np.zeros(1 << 20, dtype=bool)
    table[(model.hashes & U((1 << 20) - 1)).astype(np.int64)] = True
    keep = keep or []
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("scored text"))
    schema = base.drop("scored text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, model.bias)
            for at, data, offsets in slices(batch.column(batch.num_columns - 1)):
                text, h = features(data, offsets)
                maybe = table[(h & U((1 << 20) - 1)).astype(np.int64)]
                text, h = text[maybe], h[maybe]
                if len(h):
                    k = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
                    hit = model.hashes[k] == h
                    pair = np.unique(text[hit] * len(model.hashes) + k[hit])
                    np.add.at(score, at + pair // len(model.hashes), model.weights[pair % len(model.hashes)])
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-score))
            yield pa.record_batch([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "score"])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))

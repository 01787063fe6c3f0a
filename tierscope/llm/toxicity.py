"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and their first four and five letters, each present or not, by a hash of BITS bits. How far a
feature goes with toxic labels is its z-score, from smoothed counts over the labelled sample; it enters the regression
with the square of that, so features that say little weigh little and none is left out. A labelled text's own label doesn't count in the
z-scores of its features, so words that it alone has say nothing about it. Weights are regularised.

Grades are the levels of the label: 0 for a clean text, then each value there is. One weight vector is shared by all ordered
thresholds: P(grade > k) = sigmoid(w.x - threshold k). A text's severity is the expected grade. Labels that only tell toxic from clean
give two grades and one threshold, and the severity is the probability of the toxic one. A text is toxic where P(grade > 0) is
at least a level, which is set in the middle of where both errors on the labelled sample, clean texts counting WRONG times, add up to least.

The sample is bounded: at most CLEAN clean and TOXIC toxic labelled documents, the first by a hash of doc_id.
Everything else covers all documents and whole texts.

Defined cases: a null text is empty; with no label of one kind, or no feature in any labelled text, the severity is 0 and nothing
is toxic; labels that are null or negative are left out, and a document with several is taken once for each; repeated rows are
each returned; rows with a null doc_id are scored and have no label; an empty table gives an empty result; other columns are
ignored by `severities` and kept by `drop_toxic`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents_of, small_batches, stage

CLEAN, TOXIC = 12_000, 6_000
#: Bits of a feature's hash, what is added to counts, the least share of the largest value that is not taken for zero, how much a wrongly toxic text counts, and parts in which counts are added up.
BITS, SMOOTH, ROUNDING, WRONG, PARTS = 20, 0.5, 1e-3, 10, 64
#: Words whose features a worker remembers.
MOST_WORDS = 400_000
WORD = re.compile(r"\w+")

_known: dict[str, tuple[int, ...]] = {}


def features(text: str) -> np.ndarray:
    """Sorted numbers of a text's features."""
    import xxhash

    found: set[int] = set()
    if len(_known) > MOST_WORDS:
        _known.clear()
    for w in set(WORD.findall(text.lower())):
        own = _known.get(w)
        if own is None:
            names = (w, "4:" + w[:4], "5:" + w[:5]) if len(w) > 4 else (w,)
            own = _known[w] = tuple(xxhash.xxh32_intdigest(n.encode()) >> (32 - BITS) for n in names)
        found.update(own)
    return np.array(sorted(found), np.int64)


def sample(docs: DataFrame, labels: DataFrame, clean: int = CLEAN, toxic: int = TOXIC) -> DataFrame:
    """doc_id, text, toxic of the labelled sample."""
    told = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic >= 0")
    first = [told.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(n) for kind, n in (("toxic = 0", clean), ("toxic > 0", toxic))]
    return documents_of(docs).join(F.broadcast(first[0].union(first[1])), "doc_id").select("doc_id", "text", "toxic")


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: np.ndarray | float, n_clean: np.ndarray | float) -> np.ndarray:
    """Signed square of the z-score of features that so many toxic and clean texts have."""
    p = (toxic + clean + SMOOTH) / (n_toxic + n_clean + 2 * SMOOTH)
    z = (toxic / n_toxic - clean / n_clean) / np.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_clean))
    return np.sign(z) * z**2


class Sums:
    """Sums of float32 values by an index that doesn't change, as float64."""

    def __init__(self, index: np.ndarray, size: int):
        self.order = np.argsort(index, kind="stable").astype(np.int32)
        own = index[self.order]
        self.begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        self.there, self.size = own[self.begin], size

    def of(self, ordered: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(ordered):
            out[self.there] = np.add.reduceat(ordered, self.begin, dtype=np.float64)
        return out


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, levels: int, steps: int = 200, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the proportional-odds model, by Adam on the whole (sparse) sample. row: in order."""
    n, k = len(grade), levels - 1
    value = value.astype(np.float32)
    by_row, by_column = Sums(row, n), Sums(column, n_features)
    there, weighing = row[by_column.order].astype(np.int32), value[by_column.order]
    column = column.astype(np.int32)
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(k - 1)])  # weights, first threshold, log gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, steps + 1):
        w, gap = p[:n_features], np.exp(p[n_features + 1 :])
        cut = p[n_features] + np.concatenate([[0], np.cumsum(gap)])
        eta = by_row.of(value * w.astype(np.float32)[column])
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        low, high = (1 / (1 + np.exp(np.clip(eta - e, -500, 500))) for e in (edge[grade], edge[grade + 1]))  # P(y < grade), P(y <= grade)
        mass = np.maximum(high - low, 1e-12)
        dlow, dhigh = low * (1 - low) / mass, high * (1 - high) / mass
        by_eta = (dhigh - dlow).astype(np.float32)  # of -log likelihood
        by_cut = np.bincount(grade, -dhigh, levels)[:k] + np.bincount(grade, dlow, levels)[1:]
        g = np.concatenate([by_column.of(weighing * by_eta[there]) / n + decay * w, [by_cut.sum() / n], np.cumsum(by_cut[::-1])[::-1][1:] * gap / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def level(eta: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of eta with the least sum of errors, the middle one of all such cuts; toxic is at or above it."""
    scores = np.unique(eta)
    cuts = np.concatenate([[scores[0] - 1], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1]])
    missed = np.searchsorted(np.sort(eta[toxic]), cuts) / max(toxic.sum(), 1)
    wrong = 1 - np.searchsorted(np.sort(eta[~toxic]), cuts) / max((~toxic).sum(), 1)
    best = np.flatnonzero(missed + WRONG * wrong <= (missed + WRONG * wrong).min() + 1e-12)
    return float(cuts[best[len(best) // 2]])


@dataclass
class Model:
    weights: np.ndarray  # of every feature
    cut: np.ndarray  # ordered thresholds
    least: float  # P(grade > 0) from which a text is toxic

    def above(self, text: str) -> np.ndarray:
        """P(grade > k) for each threshold."""
        eta = self.weights[features(text)].sum()
        return 1 / (1 + np.exp(np.clip(self.cut - eta, -500, 500)))


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and clean texts of the sample have each feature."""

    def run(batches):
        n = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[int(toxic == 0), features(text)] += 1
        if n.any():
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([np.ascontiguousarray(x).tobytes() for x in np.split(n, PARTS, axis=1)])], ["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32) for x in table.column("n").to_pylist())
        return pa.table({"part": table.column("part")[:1], "n": pa.array([total.tobytes()])})

    out = np.zeros((2, 1 << BITS), np.int32)
    size = (1 << BITS) // PARTS
    for r in rows.select("text", "toxic").mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():  # 2**BITS numbers
        out[:, r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["n"], np.int32).reshape(2, size)
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, clean: int = CLEAN, toxic: int = TOXIC) -> Model | None:
    """The model, or None without labelled texts of both kinds that have features."""
    small_batches(docs.sparkSession)
    rows = stage(sample(docs, labels, clean, toxic), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    levels = np.array(sorted(n))
    n_clean, n_toxic = n.get(0, 0), sum(k for x, k in n.items() if x > 0)
    if not n_clean or not n_toxic:
        return None
    t, c = counted(rows)
    whole = evidence(t, c, n_toxic, n_clean)
    most = np.abs(whole).max()
    if most == 0:
        return None
    sent = docs.sparkSession.sparkContext.broadcast((t, c))

    def run(batches):
        t, c = sent.value
        for b in batches:
            held, values = [], []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                f, own = features(text), int(toxic > 0)
                without = evidence(t[f] - own, c[f] - (1 - own), max(n_toxic - own, 1), max(n_clean - (1 - own), 1)) / most
                some = np.abs(without) >= ROUNDING
                held.append(f[some].astype("<i4").tobytes())
                values.append(without[some].astype("<f4").tobytes())
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array(held, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "toxic", "held", "values"])

    # the bounded sample; in order, so that the fit doesn't depend on partitions
    got = sorted(rows.mapInArrow(run, "doc_id long, toxic int, held binary, values binary").collect(), key=lambda r: (r[0], r[1], bytes(r[2])))
    column, value = (np.concatenate([np.frombuffer(r[i], kind) for r in got]) for i, kind in ((2, "<i4"), (3, "<f4")))
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r[2]) // 4 for r in got])
    label = np.array([r[1] for r in got], np.int64)
    del got
    used, at = np.unique(column, return_inverse=True)
    at = at.astype(np.int32)
    w, cut = fit(row, at, value, np.searchsorted(levels, label), len(used), len(levels))
    weights = np.zeros(1 << BITS)
    weights[used] = w * whole[used] / most
    at_least = level(np.bincount(row, value * w[at], len(label)), label > 0)
    return Model(weights, cut, float(1 / (1 + np.exp((cut[0] - at_least) / 2))))  # midway to even odds


def severities(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, severity, grade, toxic."""
    model = train(docs, labels, **how)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches):
        m = sent.value
        for b in batches:
            p = np.array([m.above(t) for t in b.column("text").to_pylist()]).reshape(-1, len(m.cut))
            each = np.hstack([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]])
            yield pa.record_batch([b.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= m.least)], ["doc_id", "severity", "grade", "toxic"])

    return documents_of(docs).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that aren't toxic, with their own columns."""
    model = train(docs, labels, **how)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m.above(t or "")[0] < m.least for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

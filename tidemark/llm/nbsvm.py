"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Each word and pair of neighbouring words is an indicator, hashed to a fixed number of features. A feature is scaled by the log of the
ratio of its smoothed shares in the two classes; vectors are scaled to length 1. The hinge-loss SVM is fitted by dual coordinate descent
over a bounded sample, its margins are turned into probabilities by a logistic curve fitted on margins of halves left out in turn.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fold, small_batches

FEATURES_LOG2 = 19
#: Labelled documents of each class that serve for the fit, at most: those with the least hash of their id.
TRAIN_PER_CLASS = 3000
SMOOTH, COST, ROUNDS, THRESHOLD = 1.0, 1.0, 12, 0.3
#: Share of the scaled weights against their mean size, which keeps rare features near naive Bayes.
MIX = 0.9
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
KEPT_WORDS = 300_000


class _Words(dict):
    """Hash of each word, kept for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace"))
        return h


_words = _Words()


def features(text: str | None) -> np.ndarray:
    """The sorted distinct features of a whole text."""
    h = np.fromiter(map(_words.__getitem__, TOKEN.findall(text or "")), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([h * np.uint64(0x165667B19E3779F9), pairs])
    return np.unique((both >> np.uint64(64 - FEATURES_LOG2)).astype(np.int32))


@dataclass(frozen=True)
class Scorer:
    """ratio: by feature; weight: of the scaled features; slope, shift: from margin to log-odds."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        norm = float(np.sqrt(np.dot(r, r)))
        return float(np.dot(self.weight[x], r)) / norm + self.bias if norm else self.bias

    def score(self, x: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit_svm(xs: list[np.ndarray], y: np.ndarray) -> Scorer:
    """xs: features of each text; y: 0 or 1. Dual coordinate descent for the L2-regularised hinge loss, costs balanced by class."""
    d = 2**FEATURES_LOG2
    counts = [np.full(d, SMOOTH), np.full(d, SMOOTH)]
    for x, label in zip(xs, y, strict=True):
        counts[label][x] += 1
    ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float64)
    vectors = []
    for x in xs:
        r = ratio[x]
        norm = np.sqrt(np.dot(r, r))
        vectors.append(r / norm if norm else r)
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(y) / (2 * np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())]))
    w, bias, alpha, rng = np.zeros(d), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    square = np.array([np.dot(v, v) + 1 for v in vectors])
    for _ in range(ROUNDS):
        for n in rng.permutation(len(y)):
            x, v = xs[n], vectors[n]
            gradient = sign[n] * (np.dot(w[x], v) + bias) - 1
            new = min(max(alpha[n] - gradient / square[n], 0.0), cost[y[n]])
            if new != alpha[n]:
                step = (new - alpha[n]) * sign[n]
                w[x] += step * v
                bias += step
                alpha[n] = new
    mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
    return Scorer(ratio, MIX * w + (1 - MIX) * mean * np.sign(w), bias)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, towards smoothed labels (Platt, 1999), by Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, b = np.column_stack([margin, np.ones_like(margin)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (t - p) - 1e-3 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(xs: list[np.ndarray], y: np.ndarray) -> Scorer | float:
    """A scorer, or the share of ones (0.5 without labels) where one class only is there."""
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.nonzero(y == label)[0][::2]] = True
    margin = np.zeros(len(y))
    for out in (half, ~half):
        if len(set(y[~out].tolist())) < 2:
            continue
        part = fit_svm([x for x, o in zip(xs, out, strict=True) if not o], y[~out])
        margin[out] = [part.margin(xs[n]) for n in np.nonzero(out)[0]]
    slope, shift = _logistic(margin, y)
    whole = fit_svm(xs, y)
    return Scorer(whole.ratio, whole.weight, whole.bias, max(slope, 1e-3), shift)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS) -> Scorer | float:
    """Fit on docs (doc_id, text) that labels (doc_id, quality) marks 0 or 1 and that are not held out.

    Of each class the per_class ids with the least hash serve; an id with both labels counts as 0, of an id's texts one serves. The bounded sample's features come to
    the driver, a list of integers for each document.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    place = F.xxhash64(F.lit("nbsvm"), "doc_id")
    ids = [usable.where(F.col("y") == y).orderBy(place, "doc_id").limit(per_class) for y in (0, 1)]
    ids = cut(ids[0].unionByName(ids[1]), "nbsvm-ids")

    def run(batches):
        for b in batches:
            xs = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(xs, pa.list_(pa.int32()))], ["doc_id", "y", "x"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # 2 * per_class rows
    # of rows with one id, the text with the least hash
    text = text.groupBy("doc_id").agg(F.min_by(F.struct("y", "text"), F.struct(F.xxhash64("text"), "text")).alias("row")).select("doc_id", "row.*")
    rows = text.mapInArrow(run, "doc_id long, y int, x array<int>").toArrow().sort_by("doc_id")
    xs = [np.asarray(x.values, np.int32) if x.is_valid else np.zeros(0, np.int32) for x in rows["x"]]
    return fit(xs, np.asarray(rows["y"].to_numpy(), np.int64))


def score(docs: DataFrame, scorer: Scorer | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int) for each row of docs; only text decides.

    Null and empty texts are scored as having no features. Repeated rows and null ids come back as given, other columns are ignored. Where
    no label, or one class only, was there to learn from, all get the share of ones, or 0.5.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # two arrays of 2**FEATURES_LOG2 numbers

    def run(batches):
        own = shared.value
        for b in batches:
            p = [own if isinstance(own, float) else own.score(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and score every row; see train() and score()."""
    return score(docs, train(docs, labels))

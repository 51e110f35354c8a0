"""Quality by naive Bayes support vectors.

Binary indicators of byte trigrams and of n-grams over word shapes are scaled by the log ratio of their class counts; a
linear hinge-loss model is fitted to them by dual coordinate descent, and its margin is mapped to a probability by a
logistic curve fitted on rows that the model has not seen.

Defined results: a null or empty text gets the score of a document without features; equal texts get equal scores;
repeated rows are scored each, and count once in training; a null id is scored and never held out; where the labels hold
fewer than two rows of either class, every score is the share of label 1 (1 without labels); a text of any length is scored
whole; an empty table gives an empty result. Other columns are not read or returned by `score`; `keep_good` returns them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import drawn_rows, fold, share, training_labels, unit
from .text import SPACE, Words, column_bytes, mix, slices, tidy
from .toxicity import keep_rows

GRAM_BITS, SHAPE_BITS = 15, 13
SIZE = (1 << GRAM_BITS) + (1 << SHAPE_BITS)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: The bounds of the training sample: labelled documents of either class, and bytes of features.
MAX_CLASS, MAX_BYTES = 3000, 24 << 20

#: Kind of a byte: 0 lower-case or non-ASCII, 1 upper-case, 2 digit, 3 end of a sentence or comma, 4 other sign.
KIND = np.full(256, 4, np.uint8)
KIND[97:123] = KIND[128:] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[33, 44, 46, 58, 59, 63]] = 3


def features(batch: pa.RecordBatch, name: str = "text") -> list[np.ndarray]:
    """For each document its sorted distinct feature indices."""
    buf, offs = column_bytes(batch.column(batch.schema.get_field_index(name)))
    b = buf.astype(np.uint32)
    grams = np.zeros(len(b), np.uint16)
    if len(b) > 2:
        grams[:-2] = (((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)
    w = Words(buf, offs, SPACE)
    n = len(w)
    shapes = np.zeros(0, np.uint16)
    if n:
        h = w.hashes()
        same = np.zeros(n, np.uint64)
        same[1:] = h[1:] == h[:-1]
        first = w.at[:-1][np.diff(w.at) > 0]
        same[first] = 0
        ends, firsts, seconds = KIND[buf[w.ends - 1]], KIND[buf[w.starts]], KIND[buf[np.minimum(w.starts + 1, w.ends - 1)]]
        code = same << np.uint64(9) | ends.astype(np.uint64) << np.uint64(6) | firsts.astype(np.uint64) << np.uint64(3) | seconds
        lead = np.zeros((2, n), np.uint64)
        lead[0, 1:] = code[:-1] + np.uint64(1)
        lead[1, 2:] = code[:-2] + np.uint64(1)
        lead[0][first] = lead[1][first] = 0
        second = first + 1
        second = second[second < n]
        lead[1][second] = 0
        shapes = ((mix(code | lead[0] << np.uint64(12) | lead[1] << np.uint64(24)) & np.uint64((1 << SHAPE_BITS) - 1)) + np.uint64(1 << GRAM_BITS)).astype(np.uint16)
    return [np.unique(np.concatenate((grams[i : max(i, j - 2)], shapes[p:q]))) for i, j, p, q in zip(offs[:-1].tolist(), offs[1:].tolist(), w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)]


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 3, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of a linear model with hinge loss; x holds (indices, values) with a constant last feature."""
    w, alpha = np.zeros(size), np.zeros(len(x))
    norm = np.array([float(v @ v) for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            idx, v = x[i]
            g = y[i] * float(w[idx] @ v) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < tolerance:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted 0/1 outcomes, with targets drawn in by one row for each class."""
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, c = (p - t) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        g = np.array([d @ margin + 1e-3 * (a - 1), d.sum()])
        h = np.array([[c @ (margin * margin) + 1e-3, c @ margin], [c @ margin, c.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray  # with the constant's weight at the end
    curve: tuple[float, float]
    constant: float | None = None

    def margin(self, idx: np.ndarray) -> float:
        r = self.ratio[idx]
        return float(self.weights[idx] @ r) / (float(r @ r) ** 0.5 or 1.0) + float(self.weights[-1])

    def scores(self, batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
        if self.constant is not None:
            return np.full(batch.num_rows, self.constant)
        m = np.array([self.margin(x) for x in features(batch, name)])
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * m + self.curve[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_class: int = MAX_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """Trains on at most `max_class` labelled documents of either class, drawn by a hash."""
    known = training_labels(labels, "quality", FOLDS, HELD_OUT)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    constant = Model(np.zeros(0), np.zeros(0), (1.0, 0.0), n1 / (n0 + n1) if n0 + n1 else 1.0)
    if min(n0, n1) < 2:
        return constant
    picked = known.where(unit(F.col("doc_id"), seed=6) < F.when(F.col("y") == 1, share(n1, max_class)).otherwise(share(n0, max_class)))
    rows = drawn_rows(docs, picked.select("doc_id", (F.col("y") == 0).alias("low"), (F.col("y") == 1).alias("high")), features, {"low": max_class, "high": max_class}, max_bytes)
    if min(map(len, rows.values())) < 2:
        return constant
    y = np.repeat([0, 1], [len(rows["low"]), len(rows["high"])])
    found = [np.frombuffer(f, np.uint16) for f in rows["low"] + rows["high"]]
    weight = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())  # rows that a drawn row stands for

    def train(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.ones((2, SIZE))
        for i in rows:
            counts[y[i], found[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum() / (counts[0] / counts[0].sum()))
        x = []
        for i in rows:
            r = ratio[found[i]]
            x.append((np.append(found[i].astype(np.int64), SIZE), np.append(r / (float(r @ r) ** 0.5 or 1.0), 1.0)))
        cost = np.where(y[rows] == 1, 1.0, (y[rows] == 1).sum() / max(1, (y[rows] == 0).sum()))
        return ratio, dual_coordinate_descent(x, np.where(y[rows] == 1, 1.0, -1.0), cost, SIZE + 1)

    part = np.concatenate([np.arange(len(rows[k])) % 4 for k in ("low", "high")])
    seen = [(rows, np.flatnonzero(part == k)) for k in (0, 1) if len(np.unique(y[rows := np.flatnonzero(part != k)])) == 2]
    margins, at = [], []
    for rows, rest in seen:
        m = Model(*train(rows), (1.0, 0.0))
        margins += [m.margin(found[i]) for i in rest]
        at += list(rest)
    ratio, w = train(np.arange(len(y)))
    curve = platt(np.array(margins), y[at], weight[at] / weight[at].mean()) if at else (2.0, 0.0)
    return Model(ratio, w, curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))

    def judge(batches):
        for batch in batches:
            for x in slices(batch):
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(model.scores(x), pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(judge), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    return keep_rows(docs, lambda x: model.scores(x) >= THRESHOLD)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

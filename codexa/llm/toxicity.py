"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed word and word-stem indicators are trained with numpy from confirmed toxic examples (P) and
unlabelled text (U). With class prior pi the risk is ``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))``; where the second
part turns negative, the step goes the other way (Kiryo et al., 2017). The weights are those of the least risk; as scores
are read against a fixed threshold, the offset is set once more at the end, so that the mean score of U is the prior.

U is drawn from all documents outside the held-out fold, whether the label table covers them or not, and no label of them is
used. The prior is that of this population: the share of toxic rows among its documents that have a label, as an estimate that
takes labels to be given without regard to the text. P and U are drawn by hashes of the ids, with documented bounds in documents
and bytes.

Defined results: a null or empty text gets the score of a document without features; equal texts get equal scores;
repeated rows are scored each, and count once in training; a null id is scored, never held out and never drawn; without any
confirmed example every score is 0, and with confirmed examples alone nothing tells them from other text, so every score is the
prior; a text of any length is scored whole; an empty table gives an empty result. Other columns are
neither read nor returned by `score`; `keep_clean` returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import drawn_rows, fold, share, training_labels, unit
from .text import ALNUM, LOWER, Words, column_bytes, mix, slices, tidy

BITS = 18
STEMS = (4, 5, 6)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: The bounds of the training sample of labelled rows, in documents and in bytes of features.
MAX_POSITIVE, MAX_UNLABELLED, MAX_BYTES = 2500, 6000, 64 << 20


def features(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashed indicators of a slice (repeats included) and for each document its range of them.

    A word (a run of letters, digits and non-ASCII characters, A-Z lower-cased) gives its own index and those of its
    first 4, 5 and 6 bytes.
    """
    buf, offs = column_bytes(batch.column(batch.schema.get_field_index(name)))
    w = Words(buf, offs, ~ALNUM)
    sums = w.prefix_sums(LOWER)
    mask = np.uint64((1 << BITS) - 1)
    out = np.empty((len(w), 1 + len(STEMS)), np.uint32)
    out[:, 0] = w.hashes(sums=sums) & mask
    lens = w.ends - w.starts
    for k, size in enumerate(STEMS, 1):
        stem = mix(sums[np.minimum(w.starts + size, w.ends)] - sums[w.starts] + np.uint64(size << 40)) & mask
        out[:, k] = np.where(lens >= size, stem, out[:, 0])
    return out.reshape(-1), w.at * (1 + len(STEMS))


@dataclass
class Model:
    weights: np.ndarray  # members x 2**BITS
    bias: np.ndarray
    prior: float

    def margins(self, batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
        """members x documents; each indicator counts once in a document."""
        idx, at = features(batch, name)
        hits = np.flatnonzero(self.any[idx])
        docs = np.searchsorted(at, hits, "right") - 1
        pairs = np.unique(docs.astype(np.int64) << BITS | idx[hits])
        docs, idx = pairs >> BITS, pairs & ((1 << BITS) - 1)
        n = len(at) - 1
        return np.stack([np.bincount(docs, w[idx], n) + b for w, b in zip(self.weights, self.bias, strict=True)])

    @property
    def any(self) -> np.ndarray:
        if not hasattr(self, "_any"):
            self._any = (self.weights != 0).any(0)
        return self._any

    def scores(self, batch: pa.RecordBatch, name: str = "text") -> np.ndarray:
        if not len(self.weights):
            return np.zeros(batch.num_rows)
        m = np.clip(self.margins(batch, name), -30, 30)
        return (1 / (1 + np.exp(-m))).mean(0)


def risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of margins of P and U: the non-negative risk, its negative part before it is cut at 0, and the step's gradient by f_p
    and f_u: that of the risk, or where the negative part is below 0 that of its opposite."""
    s_p, s_u = 1 / (1 + np.exp(-f_p)), 1 / (1 + np.exp(-f_u))  # d/df of log(1 + exp(f)); s - 1 is that of log(1 + exp(-f))
    positive = prior * np.logaddexp(0, -f_p).mean()
    negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    if negative >= 0:
        return positive + negative, negative, prior * (s_p - 1) / len(f_p) - prior * s_p / len(f_p), s_u / len(f_u)
    return positive, negative, prior * s_p / len(f_p), -s_u / len(f_u)


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, rounds: int = 250, rate: float = 0.1, l1: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss; full-batch Adam with soft thresholding."""
    rows = [*pos, *unl]
    idx = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    is_p = row < len(pos)
    d_p, d_u = (np.bincount(idx[m], minlength=1 << BITS) for m in (is_p, ~is_p))
    lift = (d_p + 0.5) / len(pos) / ((d_u + 0.5) / len(unl))
    expected = len(pos) * (d_u + 0.5) / len(unl)
    use = (d_p >= 3) & (lift >= 2) & ((d_p - expected) / np.sqrt(expected) >= 4)
    held = np.flatnonzero(use)
    place = np.zeros(1 << BITS, np.int64)
    place[held] = np.arange(len(held))
    some = use[idx]
    idx, row = place[idx[some]], row[some]
    n_p, n = len(pos), len(rows)
    w, b = np.zeros(len(held)), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(len(held) + 1), np.zeros(len(held) + 1)
    for t in range(1, rounds + 1):
        f = np.clip(np.bincount(row, w[idx], n) + b, -30, 30)
        g = np.concatenate(risk(f[:n_p], f[n_p:], prior)[2:])
        grad = np.append(np.bincount(idx, g[row], len(held)), g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        step = rate / (1 + t / 80) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate * 50, 0)
    out = np.zeros(1 << BITS)
    out[held] = w
    return out, calibrated(np.bincount(row, w[idx], n)[n_p:], prior)


def calibrated(f: np.ndarray, prior: float) -> float:
    """The offset at which the mean score of unlabelled text, of margins f, is the prior."""
    low, high = -60.0, 60.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if (1 / (1 + np.exp(-np.clip(f + b, -30, 30)))).mean() < prior else (low, b)
    return b


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_BYTES, members: int = 2) -> Model:
    """Trains on about `max_positive` confirmed toxic documents and `max_unlabelled` of all documents at most."""
    ids = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id")
    known = training_labels(labels, "toxic", FOLDS, HELD_OUT).join(ids, "doc_id", "left_semi")
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    if not toxic:
        return Model(np.zeros((0, 1 << BITS)), np.zeros(0), 0.0)
    prior = min(max(toxic / n, 1e-3), 0.9)
    confirmed = known.where((F.col("y") == 1) & (unit(F.col("doc_id"), seed=5) < share(toxic, max_positive))).select("doc_id", F.lit(True).alias("p"), F.lit(False).alias("u"))
    drawn = ids.where(unit(F.col("doc_id"), seed=13) < share(ids.agg(F.count_distinct("doc_id")).first()[0], max_unlabelled)).select("doc_id", F.lit(False).alias("p"), F.lit(True).alias("u"))
    picked = confirmed.unionByName(drawn).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))  # of about as many ids as the bounds say

    def indicators(x):
        idx, at = features(x)
        return [np.unique(idx[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    rows = drawn_rows(docs, picked, indicators, {"p": max_positive, "u": max_unlabelled}, max_bytes)
    pos, unl = ([np.frombuffer(f, np.uint32) for f in rows[k]] for k in ("p", "u"))
    if not pos or not unl:
        return Model(np.zeros((1, 1 << BITS), np.float32), np.array([np.log(prior / (1 - prior))]), prior)
    made = [nnpu(pos, unl if members == 1 else [x for i, x in enumerate(unl) if i % (members + 1) != k] or unl, prior) for k in range(members)]
    return Model(np.stack([w for w, _ in made]).astype(np.float32), np.array([b for _, b in made]), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))

    def judge(batches):
        for batch in batches:
            for x in slices(batch):
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(model.scores(x), pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(judge), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_rows(docs: DataFrame, wanted) -> DataFrame:
    """The rows of docs, all columns as they are, for which `wanted` (a slice of text -> mask) says so."""

    def judge(batches):
        for batch in batches:
            for x in slices(batch):
                yield x.filter(pa.array(wanted(x)))

    return docs.mapInArrow(tidy(judge), docs.schema)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    return keep_rows(docs, lambda x: model.scores(x) < THRESHOLD)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and its n-grams of 3 to 5 code points are hashed to 2**18
features, each present or not.  Per feature, the two classes' counts of training
rows that have it give its log-count ratio; all features are scaled by their
ratio, and a logistic regression is fitted on them.

Training rows are labelled documents outside the held-out fold: at most
``MAX_TRAIN``, those with the smallest hash of doc_id.  That bound makes the
list of their ids safe to broadcast and their features safe to gather in one
place.  Every document's whole text is scored.

Defined cases: a null or empty text has no feature, so its score is the
intercept's; a label other than 0 or 1 is no label; an id that is labelled
twice is toxic if one of the labels says so; without training rows of both
classes every score is the training rows' smoothed share of toxic ones;
repeated documents are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

BITS = 18
ORDERS = (3, 4, 5)
#: Folds by crc32 of the id's text; fold 0 is held out.
FOLDS = 5
#: Bound on the labelled rows that the classifier is fitted on.
MAX_TRAIN = 4_000
SMOOTH = 1.0
PENALTY = 1e-4
ROUNDS = 150
#: Rows whose features are gone through at once.
STEP_ROWS = 500


def feature_ids(text: str, mark: np.ndarray) -> np.ndarray:
    """Sorted distinct features of a text; ``mark`` is a scratch array of zeros and is left so."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    rolling = code * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BITS)
    parts = []
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
        if n in ORDERS:
            mixed = rolling ^ (rolling >> np.uint32(15))
            parts.append((mixed * np.uint32(0x2C1B3C6D)) >> shift)
    for p in parts:
        mark[p] = True
    out = np.flatnonzero(mark)
    mark[out] = False
    return out


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """toxic and text of the training rows: one pass over the documents against a list of ``most`` ids (of documents that are there) at most."""
    lab = labels.filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = lab.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def feature_counts(rows: DataFrame) -> DataFrame:
    """Per feature, the rows of either class that have it, added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, dtype=bool)
        count = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                count[label][feature_ids(text.as_py() or "", mark)] += 1
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(count[0][at]), pa.array(count[1][at])], names=["at", "c0", "c1"])

    return rows.mapInArrow(run, "at long, c0 long, c1 long").groupBy("at").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def ratios(counts: DataFrame, n0: int, n1: int) -> pd.DataFrame:
    """The log-count ratio of each feature that any training row has (2**18 at most)."""
    ratio = F.log(((F.col("c1") + SMOOTH) / (n1 + 2 * SMOOTH)) / ((F.col("c0") + SMOOTH) / (n0 + 2 * SMOOTH)))
    return counts.select("at", ratio.alias("ratio")).toPandas().sort_values("at")


def kept_features(rows: DataFrame, slot: np.ndarray) -> DataFrame:
    """Per training row, the slots of the kept features that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                at = slot[feature_ids(text.as_py() or "", mark)]
                out.append(at[at >= 0].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.binary())], names=["toxic", "slots"])

    return rows.mapInArrow(run, "toxic int, slots binary")


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and intercept, by accelerated gradient steps on the penalised mean loss."""
    n, k = len(rows), len(scale)
    # rows by pieces of a bounded size, so that nothing as long as all their features is ever made but these
    flat = np.concatenate(rows).astype(np.int32)
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [*range(0, n, STEP_ROWS), n]
    parts = [(slice(f, e), flat[begin[f] : begin[e]], np.repeat(np.arange(e - f, dtype=np.int32), sizes[f:e])) for f, e in zip(cuts, cuts[1:])]

    def forward(w: np.ndarray, b: float) -> np.ndarray:
        scaled = w * scale
        return np.concatenate([np.bincount(row, weights=scaled[at], minlength=some.stop - some.start) for some, at, row in parts]) + b

    def backward(e: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        for some, at, row in parts:
            out += np.bincount(at, weights=e[some][row], minlength=k)
        return out * scale

    v = np.ones(k) / np.sqrt(max(k, 1))
    size = 1.0
    for _ in range(15):  # largest curvature, by power iteration
        v = backward(forward(v, 0.0)) / n
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (0.25 * (size * 1.1 + 1) + PENALTY)
    share = y.mean()
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    pw, pb = w, b
    for t in range(ROUNDS):
        m = t / (t + 3)
        qw, qb = w + m * (w - pw), b + m * (b - pb)
        error = (1 / (1 + np.exp(-np.clip(forward(qw, qb), -30, 30))) - y) / n
        pw, pb = w, b
        w = qw - step * (backward(error) + PENALTY * qw)
        b = qb - step * error.sum()
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weight of each of the 2**18 features (0 for those that no training row has) and the intercept."""
    rows = training_rows(docs, labels, most)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        p = (n1 + 0.5) / (n0 + n1 + 1)
        return weights, float(np.log(p / (1 - p)))
    kept = ratios(feature_counts(rows), n0, n1)
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[kept["at"].to_numpy()] = np.arange(len(kept))
    found = kept_features(rows, slot).toPandas()
    found = found.assign(n=found["slots"].str.len()).sort_values(["toxic", "n", "slots"])  # the same order in every run
    w, b = logistic([np.frombuffer(x, dtype="<u4") for x in found["slots"]], found["toxic"].to_numpy(dtype=float), kept["ratio"].to_numpy())
    weights[kept["at"].to_numpy()] = w * kept["ratio"].to_numpy()
    return weights, float(b)


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    at = np.flatnonzero(weights).astype(np.int64)
    value = weights[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, dtype=bool)
        w = np.zeros(1 << BITS, dtype=np.float64)
        w[at] = value
        for batch in batches:
            z = np.array([w[feature_ids(x.as_py() or "", mark)].sum() for x in batch.column("text")]) + intercept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, *fit(docs, labels))

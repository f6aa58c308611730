"""Motif scan: position weight matrices over region sequences, both strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ACGT"
_CODE = np.full(256, 4, dtype=np.int64)
_CODE[[ord(c) for c in LETTERS]] = range(4)


def log_odds(counts: np.ndarray, pseudo: float = 0.25, background: float = 0.25) -> np.ndarray:
    """Log2 odds of a 4 x width count matrix; other letters score the column's minimum."""
    p = (counts + pseudo) / (counts + pseudo).sum(axis=0)
    w = np.log2(p / background)
    return np.vstack([w, w.min(axis=0)])


def scores(sequence: str, weights: np.ndarray) -> np.ndarray:
    """Score at each start of the sequence."""
    code = _CODE[np.frombuffer(sequence.upper().encode("ascii", "replace"), dtype=np.uint8)]
    width = weights.shape[1]
    if len(code) < width:
        return np.zeros(0)
    return sum(weights[code[k : len(code) - width + 1 + k], k] for k in range(width))


def threshold(weights: np.ndarray, p_value: float, steps: int = 1000) -> float:
    """Smallest score with at most this tail probability under uniform letters, by convolving discretised scores."""
    w = weights[:4]
    low = w.min(axis=0).sum()
    unit = max((w.max(axis=0).sum() - low) / steps, 1e-9)
    dist = np.ones(1)
    for column in w.T:
        at = np.round((column - column.min()) / unit).astype(int)
        new = np.zeros(len(dist) + at.max())
        for a in at:
            new[a : a + len(dist)] += dist / 4
        dist = new
    tail = np.cumsum(dist[::-1])[::-1]
    hit = np.flatnonzero(tail <= p_value)
    return low + unit * (hit[0] if len(hit) else len(dist))


def scan(sequences: DataFrame, motifs: dict[str, np.ndarray], p_value: float = 5e-5) -> DataFrame:
    """(region, motif_id, pos, strand, score) of every hit; ``sequences`` has region and sequence, the motifs are a small dictionary."""
    ready = []
    for name, counts in sorted(motifs.items()):
        w = log_odds(np.asarray(counts, dtype=float))
        turned = np.vstack([w[3::-1, ::-1], w[4:, ::-1]])  # complement of A C G T is T G C A
        ready.append((name, threshold(w, p_value), (("+", w), ("-", turned))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for region, sequence in zip(batch.column("region").to_pylist(), batch.column("sequence").to_pylist(), strict=True):
                for name, least, strands in ready:
                    for strand, w in strands:
                        s = scores(sequence or "", w)
                        rows += [(region, name, int(k), strand, float(s[k])) for k in np.flatnonzero(s >= least)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["region", "motif_id", "pos", "strand", "score"])

    return sequences.select("region", "sequence").mapInArrow(run, "region string, motif_id string, pos long, strand string, score double")


def hit_matrix(hits: DataFrame) -> DataFrame:
    """Best score of each motif in each region."""
    return hits.groupBy("region", "motif_id").agg(F.max("score").alias("score"))

"""De-novo regions: sliding windows of variable methylation, and segments along a track."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .axis import range_join


def sliding_windows(sites: DataFrame, width: int = 3000, step: int = 500) -> DataFrame:
    """Per window of centres first+h+1, first+h+1+step, ...: mean, variance and number of the cells' means.

    A cell's mean is its methylated sites by its stored ones in
    [centre-h-1, centre+h-1).  A site falls into at most width / step windows,
    which it reaches by arithmetic.
    """
    h = width // 2
    ends = sites.groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    start0 = F.col("lo") + h + 1
    rows = sites.join(F.broadcast(ends), "chrom")  # a row a chromosome
    last = F.floor((F.col("hi") - h - 1 - start0 - 1) / step)
    first_k = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - start0 - h + 2) / step))
    last_k = F.least(last, F.floor((F.col("pos") - start0 + h + 1) / step))
    rows = rows.filter(first_k <= last_k).withColumn("k", F.explode(F.sequence(first_k, last_k)))
    rows = rows.withColumn("centre", start0 + F.col("k") * step)
    cell = rows.groupBy("chrom", "centre", "cell_id").agg((F.count_if(F.col("state") == 1) / F.count(F.lit(1))).alias("m"))
    out = cell.groupBy("chrom", "centre").agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var"), F.count(F.lit(1)).alias("n_cells"))
    return out.select("chrom", (F.col("centre") - h).alias("start_pos"), (F.col("centre") + h).alias("end_pos"), "mean", "var", "n_cells")


def outliers(windows: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Windows whose variance is more than so many standard deviations from its chromosome's mean."""
    told = windows.groupBy("chrom").agg(F.avg("var").alias("mu"), F.stddev_pop("var").alias("sd"), F.count("var").alias("n"))
    joined = windows.join(F.broadcast(told), "chrom")
    far = (F.col("var") < F.col("mu") - sigmas * F.col("sd")) | (F.col("var") > F.col("mu") + sigmas * F.col("sd"))
    return joined.filter(far & (F.col("n") >= 2)).drop("mu", "sd", "n")


def segment_metrics(track: DataFrame, regions: DataFrame, bin_width: int = 1000) -> DataFrame:
    """Length, sites, mean, deviation, median, density and largest gap of each segment's positions."""
    # closed ends: the join's predicate is shifted by one
    closed = regions.select("chrom", (F.col("start_pos") + 1).alias("start_pos"), (F.col("end_pos") + 1).alias("end_pos"))
    rows = range_join(track.select("chrom", "pos", "value"), closed, bin_width)
    rows = rows.select("chrom", (F.col("start_pos") - 1).alias("start_pos"), (F.col("end_pos") - 1).alias("end_pos"), "pos", "value")
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("chrom", "start_pos").orderBy("pos"))
    out = rows.withColumn("gap", gap).groupBy("chrom", "start_pos", "end_pos").agg(
        F.count(F.lit(1)).alias("num_sites"),
        F.count("value").alias("n_value"),
        F.avg("value").alias("mean_smooth"),
        F.stddev_pop("value").alias("std_smooth"),
        F.median("value").alias("median_smooth"),
        F.coalesce(F.max("gap"), F.lit(0).cast("long")).alias("max_site_gap"),
    )
    length = F.col("end_pos") - F.col("start_pos")
    return out.withColumns(
        {"length_bp": length, "site_density": F.when(length > 0, F.col("num_sites") * 1000 / length).otherwise(F.lit(0.0)), "data_completeness": F.col("n_value") / F.col("num_sites")}
    ).drop("n_value")


def classify(metrics: DataFrame, low: float = 0.3, high: float = 0.7, min_length: int = 100, max_length: int = 10_000_000, max_gap: int = 5000, completeness: float = 0.7) -> DataFrame:
    """Valid segments with their type by mean level."""
    ok = (F.col("num_sites") >= 2) & F.col("length_bp").between(min_length, max_length) & (F.col("max_site_gap") <= max_gap) & (F.col("data_completeness") >= completeness)
    kind = F.when(F.col("mean_smooth") < low, "LMR").when(F.col("mean_smooth") > high, "HMR").otherwise("PMR")
    return metrics.filter(ok).withColumn("type", kind)


def two_sided_normal(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def change_points(values: np.ndarray, alpha: float = 0.01, least: int = 5) -> list[tuple[int, int]]:
    """Segments (start, end) by recursive halving at the split with the largest Welch statistic."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    square = np.concatenate([[0.0], np.cumsum(values**2)])
    out: list[tuple[int, int]] = []
    open_ = [(0, len(values))]
    while open_:
        a, b = open_.pop()
        n = b - a
        if n >= 2 * least:
            k = np.arange(a + least, b - least + 1)
            n1, n2 = k - a, b - k
            m1, m2 = (total[k] - total[a]) / n1, (total[b] - total[k]) / n2
            v1 = np.maximum(square[k] - square[a] - n1 * m1**2, 0) / np.maximum(n1 - 1, 1)
            v2 = np.maximum(square[b] - square[k] - n2 * m2**2, 0) / np.maximum(n2 - 1, 1)
            t = np.abs(m1 - m2) / np.sqrt(v1 / n1 + v2 / n2 + 1e-12)
            best = int(np.argmax(t))
            if abs(m1[best] - m2[best]) > 1e-9 and two_sided_normal(float(t[best])) < alpha:
                open_ += [(int(k[best]), b), (a, int(k[best]))]
                continue
        out.append((a, b))
    return out


SEGMENTS = "chrom string, run long, start_pos long, end_pos long, num_sites long, mean_smooth double"


def segment(track: DataFrame, gap: int = 10_000, alpha: float = 0.01, least: int = 5) -> DataFrame:
    """Segments of each gap-free run of a track (chrom, pos, value); runs are independent of each other."""
    w = Window.partitionBy("chrom").orderBy("pos")
    runs = track.withColumn("_cut", F.when(F.col("pos") - F.lag("pos").over(w) > gap, 1).otherwise(0)).withColumn("run", F.sum("_cut").over(w)).drop("_cut")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        v, p = rows["value"].to_numpy(dtype=float), rows["pos"].to_numpy()
        made = [(rows["chrom"].iloc[0], rows["run"].iloc[0], p[a], p[b - 1], b - a, v[a:b].mean()) for a, b in change_points(v, alpha, least)]
        return pd.DataFrame(made, columns=["chrom", "run", "start_pos", "end_pos", "num_sites", "mean_smooth"])

    return runs.filter("value IS NOT NULL").groupBy("chrom", "run").applyInPandas(cut, SEGMENTS)


def merge_segments(segments: DataFrame, gap: int = 500, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Neighbouring segments of one type at most ``gap`` apart joined, their means weighted by sites."""
    kind = F.when(F.col("mean_smooth") < low, "LMR").when(F.col("mean_smooth") > high, "HMR").otherwise("PMR")
    w = Window.partitionBy("chrom").orderBy("start_pos")
    typed = segments.withColumn("type", kind)
    new = (F.lag("type").over(w) != F.col("type")) | (F.col("start_pos") - F.lag("end_pos").over(w) > gap)
    typed = typed.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    return typed.groupBy("chrom", "_island", "type").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("num_sites").alias("num_sites"),
        (F.sum(F.col("mean_smooth") * F.col("num_sites")) / F.sum("num_sites")).alias("mean_smooth"), F.count(F.lit(1)).alias("n_merged"),
    ).drop("_island")


def adjacent_tests(track: DataFrame, width: int) -> DataFrame:
    """Welch statistic between the ``width`` sites up to each position and the ``width`` after it."""
    w = Window.partitionBy("chrom").orderBy("pos")
    left, right = w.rowsBetween(-width + 1, 0), w.rowsBetween(1, width)
    parts = {f"{n}{s}": f("value").over(o) for s, o in (("1", left), ("2", right)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))}
    rows = track.withColumns(parts).filter((F.col("n1") == width) & (F.col("n2") == width))
    error = F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    return rows.select("chrom", "pos", F.when(error > 0, (F.col("m1") - F.col("m2")) / error).alias("t"))


def thin(points: Iterator[int], least: int) -> list[int]:
    """Ascending points without those closer than ``least`` to the last one kept."""
    out: list[int] = []
    for p in points:
        if not out or p - out[-1] >= least:
            out.append(p)
    return out

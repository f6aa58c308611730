"""Kernel smoothers along a chromosome.

Each covered position averages the positions of its frame, weighted by a kernel
and by the log of how many cells cover them.  The frame is a range window of a
block of positions with a halo, so it needs one shuffle and no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sites import entropy, tricube
from .axis import with_halo

BLOCK = 1_000_000


def fractions(sites: DataFrame) -> DataFrame:
    """Per position: stored entries, methylated ones and their share."""
    out = sites.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(F.col("state") > 0).alias("n_meth"))
    return out.withColumn("mfrac", F.col("n_meth") / F.col("n_obs"))


def _average(frame: Column, weight) -> Column:
    """Weighted mean of the frame's values; null if the weights add up to 0."""
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))

    def step(a: Column, x: Column) -> Column:
        k = weight(x)
        return F.struct((a["v"] + x["y"] * k).alias("v"), (a["w"] + k).alias("w"))

    return F.aggregate(frame, zero, step, lambda a: F.when(a["w"] > 0, a["v"] / a["w"]))


def tricube_smooth(track: DataFrame, bandwidth: int = 1000, value: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(chrom, pos, value): frame [pos-h, pos+h) with h = bandwidth // 2, kernel centred at both edges."""
    h = bandwidth // 2
    y = F.col("mfrac") if value is None else value
    track = with_halo(track.select("chrom", "pos", y.alias("y"), F.log1p(F.col("n_obs").cast("double")).alias("lw")), h, h, max(block, h))
    frame = Window.partitionBy("chrom", "block").orderBy("pos").rangeBetween(-h, h - 1)
    seen = track.withColumn("frame", F.collect_list(F.struct("pos", "y", "lw")).over(frame)).filter("own")
    smoothed = _average(F.col("frame"), lambda x: tricube(x["pos"] - F.col("pos"), h) * x["lw"])
    return seen.select("chrom", "pos", smoothed.alias("value"))


def entropy_smooth(track: DataFrame, bandwidth: int = 1000, block: int = BLOCK) -> DataFrame:
    """As ``tricube_smooth``, over the binary entropy of the shares."""
    return tricube_smooth(track, bandwidth, entropy(F.col("mfrac")), block)


def adaptive_smooth(track: DataFrame, neighbours: int = 10, cap: int = 1500, block: int = BLOCK) -> DataFrame:
    """(chrom, pos, bandwidth, value): gaussian kernel whose bandwidth is the distance to the n-th nearest position.

    The position itself counts as the first; the bandwidth is capped, and the
    frame is [pos-b, pos+b).  Null for a bandwidth of 0.
    """
    rows = with_halo(track.select("chrom", "pos", F.col("mfrac").alias("y"), F.log1p(F.col("n_obs").cast("double")).alias("lw")), cap, cap, max(block, cap))
    near = Window.partitionBy("chrom", "block").orderBy("pos").rangeBetween(-cap, cap)
    rows = rows.withColumn("frame", F.collect_list(F.struct("pos", "y", "lw")).over(near)).filter("own")
    distances = F.array_sort(F.transform("frame", lambda x: F.abs(x["pos"] - F.col("pos"))))
    rows = rows.withColumn("bandwidth", F.least(F.coalesce(F.get(distances, F.lit(neighbours - 1)), F.lit(cap).cast("long")), F.lit(cap).cast("long")))
    b = F.col("bandwidth")
    inside = F.filter("frame", lambda x: (x["pos"] >= F.col("pos") - b) & (x["pos"] < F.col("pos") + b))
    smoothed = _average(inside, lambda x: F.exp(-F.pow((x["pos"] - F.col("pos")) / b.cast("double"), 2)) * x["lw"])
    return rows.select("chrom", "pos", b, F.when(b > 0, smoothed).alias("value"))


def null_edges(track: DataFrame, bandwidth: int) -> DataFrame:
    """The track without values where the kernel would reach over either end of the chromosome."""
    half = bandwidth // 2
    last = track.groupBy("chrom").agg(F.max("pos").alias("_last"))
    inside = (F.col("pos") >= half) & (F.col("pos") + half <= F.col("_last") + 1)
    return track.join(F.broadcast(last), "chrom").withColumn("value", F.when(inside, F.col("value"))).drop("_last")

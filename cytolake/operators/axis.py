"""Ordered-axis building blocks: blocks with a halo, range joins, tiles, merges, nearest.

A chromosome is an ordered axis of positions.  Work on it is dealt by fixed
blocks of positions, never by chromosome, so a long chromosome is many tasks;
what looks over a block's edge gets copies of the rows near the edge (its halo).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, before: int, after: int, block: int, pos: str = "pos") -> DataFrame:
    """Each row in its own block (``own``) and in every block whose rows see it at -before..+after."""
    if block < max(before, after, 1):
        raise ValueError("a block must be at least as long as its halo")
    first = F.floor((F.col(pos) - after) / block)
    last = F.floor((F.col(pos) + before) / block)
    out = df.withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumn("own", F.col("block") == F.floor(F.col(pos) / block))


def tile_of(pos: Column, width: int) -> Column:
    """Number of the tile that holds the position under the default predicate start-1 <= pos <= end-1."""
    return F.floor(pos / width)


def tiles(chrom_sizes: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """1-based closed windows along each chromosome, capped at its length."""
    step = step or width
    start = F.explode(F.sequence(F.lit(1).cast("long"), F.col("length").cast("long"), F.lit(step).cast("long")))
    out = chrom_sizes.select("chrom", "length", start.alias("start_pos"))
    return out.select("chrom", "start_pos", F.least(F.col("start_pos") + width - 1, F.col("length")).alias("end_pos"))


def range_join(sites: DataFrame, regions: DataFrame, bin_width: int = 1000, how: str = "inner", half_open: bool = False) -> DataFrame:
    """Sites with the regions that hold them: start-1 <= pos <= end-1 (or < end-1).

    Regions are listed under each bin that they touch and sites have one bin,
    so a pair meets once, in an equi-join by chromosome and bin.
    """
    last = F.col("end_pos") - (2 if half_open else 1)
    first = F.col("start_pos") - 1
    listed = regions.filter(first <= last).withColumn("_bin", F.explode(F.sequence(F.floor(first / bin_width), F.floor(last / bin_width))))
    keyed = sites.withColumn("_bin", F.floor(F.col("pos") / bin_width)).alias("s")
    listed = listed.alias("r")
    at = F.col("s.pos")
    upper = at < F.col("r.end_pos") - 1 if half_open else at <= F.col("r.end_pos") - 1
    on = (F.col("s.chrom") == F.col("r.chrom")) & (F.col("s._bin") == F.col("r._bin")) & (at >= F.col("r.start_pos") - 1) & upper
    extra = [F.col(f"r.{c}") for c in regions.columns if c not in sites.columns]
    return keyed.join(listed, on, how).select(*[F.col(f"s.{c}") for c in sites.columns], *extra)


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int = 1000, how: str = "inner") -> DataFrame:
    """Interval pairs that overlap (closed ends); columns of ``right`` are prefixed with ``other_``.

    A pair that shares several bins is kept in the bin of its overlap's start only.
    """
    cut = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_pos") / bin_width), F.floor(F.col("end_pos") / bin_width))))
    if how == "left":
        left = left.withColumn("_row", F.struct(*left.columns))
        found = overlap_join(left, right, bin_width)
        names = [c for c in found.columns if c.startswith("other_")]
        hit = found.select(F.col("_row").alias("_hit"), *names)
        return left.join(hit, F.col("_row").eqNullSafe(F.col("_hit")), "left").drop("_row", "_hit")
    a, b = cut(left).alias("a"), cut(right).alias("b")
    on = (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a._bin") == F.col("b._bin"))
    on = on & (F.col("a.start_pos") <= F.col("b.end_pos")) & (F.col("b.start_pos") <= F.col("a.end_pos"))
    on = on & (F.col("a._bin") == F.floor(F.greatest(F.col("a.start_pos"), F.col("b.start_pos")) / bin_width))
    return a.join(b, on).select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}").alias(f"other_{c}") for c in right.columns])


def merge_intervals(df: DataFrame, gap: int = 0) -> DataFrame:
    """Overlapping or touching intervals (start <= end so far + gap) joined, with how many there were."""
    w = Window.partitionBy("chrom").orderBy("start_pos", "end_pos")
    so_far = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(so_far.isNull() | (F.col("start_pos") > so_far + gap), 1).otherwise(0)
    island = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w))
    return island.groupBy("chrom", "_island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_merged")).drop("_island")


def _so_far(rows: DataFrame, best: Column, block: int) -> DataFrame:
    """``rows`` with ``hit``: the largest ``best`` at a smaller ``at`` on the chromosome.

    Rows are ordered within blocks; a block gets the best of all blocks before from their list, a row a block.
    """
    rows = rows.withColumn("_block", F.floor(F.col("at") / block))
    own = Window.partitionBy("chrom", "_block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("chrom", "_block").agg(F.max(best).alias("_top")).withColumn("_carried", F.max("_top").over(before)).drop("_top")
    found = rows.withColumn("_own", F.max(best).over(own)).filter("is_region = 1")
    return found.join(carried, ["chrom", "_block"]).withColumn("hit", F.greatest("_own", "_carried")).filter("hit IS NOT NULL")


def nearest(regions: DataFrame, genes: DataFrame, key: str, gene_key: str, block: int = 50_000) -> DataFrame:
    """One nearest gene per region: distance 0 when overlapping, else the gap; ties by gene start, end and id.

    Candidates are the overlapping genes, the last to end before and the first
    to start after the region, found by running extremes over ordered blocks of positions.
    """
    gene = genes.select("chrom", F.col(gene_key), F.col("start_pos").alias("gs"), F.col("end_pos").alias("ge"))
    inside = overlap_join(regions.select("chrom", key, "start_pos", "end_pos"), genes.select("chrom", gene_key, "start_pos", "end_pos"))
    inside = inside.select(key, F.col(f"other_{gene_key}").alias(gene_key), F.lit(0).cast("long").alias("distance"), F.col("other_start_pos").alias("gs"), F.col("other_end_pos").alias("ge"))

    def side(gene_at: str, region_at: str, sign: int) -> DataFrame:
        """Of each region the gene whose ``gene_at`` is nearest on one side; of those that share it, the first by start, end and id."""
        edges = gene.groupBy("chrom", (sign * F.col(gene_at)).alias("hit")).agg(F.min(F.struct("gs", "ge", gene_key)).alias("g"))
        g = edges.select("chrom", F.col("hit").alias("at"), F.lit(None).cast(regions.schema[key].dataType).alias(key), F.lit(0).alias("is_region"))
        r = regions.select("chrom", (sign * F.col(region_at)).alias("at"), key, F.lit(1).alias("is_region"))
        hit = _so_far(g.unionByName(r), F.when(F.col("is_region") == 0, F.col("at")), block)
        return hit.join(edges, ["chrom", "hit"]).select(key, F.col(f"g.{gene_key}").alias(gene_key), (F.col("at") - F.col("hit")).alias("distance"), "g.gs", "g.ge")

    # on the right the axis is turned round, so that both sides look at what came before
    every = inside.unionByName(side("ge", "start_pos", 1)).unionByName(side("gs", "end_pos", -1))
    best = every.groupBy(key).agg(F.min(F.struct("distance", "gs", "ge", gene_key)).alias("best"))
    return regions.select(key).join(best, key, "left").select(key, F.col(f"best.{gene_key}").alias(gene_key), F.col("best.distance").alias("distance"))


def gap_regions(df: DataFrame, threshold: int, least: int = 2) -> DataFrame:
    """Runs of positions without a gap over the threshold, of at least ``least`` sites."""
    w = Window.partitionBy("chrom").orderBy("pos")
    cut = F.when(F.col("pos") - F.lag("pos").over(w) > threshold, 1).otherwise(0)
    run = df.withColumn("_cut", cut).withColumn("run", F.sum("_cut").over(w))
    out = run.groupBy("chrom", "run").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("n_sites"))
    return out.filter(F.col("n_sites") >= least).drop("run")


def tiles_from_zero(chrom_sizes: DataFrame, width: int, step: int) -> DataFrame:
    """Half-open windows from 0 on, the last ones cut at the chromosome's length."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    return chrom_sizes.filter("length > 0").select("chrom", "length", start.alias("start_pos")).select("chrom", "start_pos", F.least(F.col("start_pos") + width, F.col("length")).alias("end_pos"))

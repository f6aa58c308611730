"""The cell x region matrix as a long table: means, residuals, statistics, filters, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sites import region_name
from .axis import range_join, tile_of
from .ranked import global_rank


def cell_qc(sites: DataFrame) -> DataFrame:
    """Sites, methylated sites, total coverage and global level of each cell."""
    out = sites.groupBy("cell_id").agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("state") == 1).alias("meth"), F.sum("cov").alias("n_total"))
    return out.withColumn("global_meth_level", F.when(F.col("sites") > 0, F.col("meth") / F.col("sites")).otherwise(F.lit(0.0)))


def mean_of(state: Column) -> Column:
    """Aggregate: share of methylated among the unambiguous, half-even to three places; null without any."""
    told = F.count_if(state != 0)
    return F.when(told > 0, F.bround(F.count_if(state == 1) / told, 3))


def tile_mean(sites: DataFrame, width: int) -> DataFrame:
    """Region mean over tiles, by arithmetic instead of a join."""
    tiled = sites.withColumn("tile", tile_of(F.col("pos"), width))
    out = tiled.groupBy("cell_id", "chrom", "tile").agg(mean_of(F.col("state")).alias("mean"), F.count_if(F.col("state") != 0).alias("n_obs"))
    start = F.col("tile") * width + 1
    return out.select("cell_id", region_name(F.col("chrom"), start, start + width - 1).alias("region"), "mean", "n_obs").filter("mean IS NOT NULL")


def region_matrix(sites: DataFrame, regions: DataFrame, smooth: DataFrame | None = None, shrinkage: float = 1.0, bin_width: int = 1000) -> DataFrame:
    """(cell_id, region, mean, n_obs[, relative]): mean and, with a smooth track, the shrunken residual."""
    told = sites.filter("state <> 0")
    if smooth is not None:
        told = told.join(smooth.select("chrom", "pos", "value"), ["chrom", "pos"], "left")
    # a region of one position holds none, as its rows' slice is empty
    joined = range_join(told, regions.filter("start_pos < end_pos"), bin_width)
    aggs = [mean_of(F.col("state")).alias("mean"), F.count(F.lit(1)).alias("n_obs")]
    if smooth is not None:
        above = F.sum(F.when(F.col("state") > 0, F.col("state")).otherwise(0)) - F.sum(F.coalesce("value", F.lit(0.0)))
        aggs.append((above / (F.count(F.lit(1)) + shrinkage)).alias("relative"))
    return joined.groupBy("cell_id", "region").agg(*aggs)


def exact_moments(c: str, units: int) -> tuple[Column, Column]:
    """Mean and population variance of values counted in ``units`` of one, from integer sums, so that no order of rows shows."""
    k = F.floor(F.col(c) * float(units) + 0.5).cast("decimal(19,0)")
    n, total, squares = F.count(c), F.sum(k).cast("decimal(38,0)"), F.sum((k * k).cast("decimal(38,0)")).cast("decimal(38,0)")
    spread = (n.cast("decimal(18,0)") * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    many = n.cast("double")
    return total.cast("double") / (many * float(units)), spread.cast("double") / (many * many * float(units) * float(units))


def region_stats(matrix: DataFrame, guard: bool = True) -> DataFrame:
    """Covered cells, variance of the mean and of the residual; null variances for one cell if ``guard``.

    Means have three places and are taken as thousandths; residuals are rounded to nine places.
    """

    def guarded(c: str, spread: Column) -> Column:
        return F.when(F.count(c) > 1, spread) if guard else F.when(F.count(c) > 0, spread)

    mean, var = exact_moments("mean", 1000)
    aggs = [F.count("mean").alias("covered_cell"), mean.alias("mean"), guarded("mean", var).alias("var")]
    if "relative" in matrix.columns:
        aggs.append(guarded("relative", exact_moments("relative", 10**9)[1]).alias("sr_var"))
    return matrix.groupBy("region").agg(*aggs)


def between(c: Column, low, high) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    return ok if high is None else ok & (c <= high)


def filter_features(matrix: DataFrame, n_cells: int, min_n=None, max_n=None, min_pct=None, max_pct=None) -> DataFrame:
    """Regions with their covered cells, mean and share, within inclusive bounds (None: no bound)."""
    stats = matrix.groupBy("region").agg(F.count("mean").alias("covered_cell"), F.avg("mean").alias("mean"))
    stats = stats.withColumn("pct_cell", F.col("covered_cell") / float(n_cells))
    return stats.filter(between(F.col("covered_cell"), min_n, max_n) & between(F.col("pct_cell"), min_pct, max_pct))


def filter_cells(matrix: DataFrame, qc: DataFrame, n_regions: int, min_n=None, max_n=None, min_pct=None, max_pct=None, min_level=None, max_level=None, min_sites=None) -> DataFrame:
    """Cells with their covered regions and share, within inclusive bounds."""
    stats = matrix.groupBy("cell_id").agg(F.count("mean").alias("n_features")).join(qc.select("cell_id", "sites", "global_meth_level"), "cell_id")
    stats = stats.withColumn("pct_features", F.col("n_features") / float(n_regions))
    ok = between(F.col("n_features"), min_n, max_n) & between(F.col("pct_features"), min_pct, max_pct)
    return stats.filter(ok & between(F.col("global_meth_level"), min_level, max_level) & between(F.col("sites"), min_sites, None))


def filter_genes(matrix: DataFrame, cutoff: float, min_cells: int, min_count: float) -> DataFrame:
    """Regions with more cells above the cutoff and a larger sum than asked for (both strict)."""
    stats = matrix.groupBy("region").agg(F.count_if(F.col("mean") > cutoff).alias("n_cells"), F.sum("mean").alias("n_counts"))
    return stats.filter((F.col("n_cells") > min_cells) & (F.col("n_counts") > min_count))


def top_variable(stats: DataFrame, n: int, by: str = "sr_var") -> DataFrame:
    """The n regions with the largest variance (ties by name); a top-k of one row set, merged task by task."""
    return stats.filter(F.col(by).isNotNull()).orderBy(F.desc(by), "region").limit(n)


def trim_quantiles(stats: DataFrame, save, count: str, low: float, high: float, n: int) -> DataFrame:
    """Regions without the lowest and highest shares by rank, the n largest of the rest; ``save`` writes a table and reads it again."""
    some = stats.filter(F.col(count) > 0)
    total = some.count()
    ranked = global_rank(some.select("region", count), save, count, "region").withColumn("rank", F.col("rank") - 1)
    kept = ranked.filter((F.col("rank") >= int(total * low)) & (F.col("rank") < int(total * (1 - high))))
    return kept.select("region", count).orderBy(F.desc(count), "region").limit(n)


def zscore(matrix: DataFrame) -> DataFrame:
    """(x - mean) / (variance + 1) within each region; the divisor is the variance plus one by definition."""
    w = Window.partitionBy("region")
    return matrix.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / (F.var_pop("mean").over(w) + 1))


def minmax(matrix: DataFrame, by: str) -> DataFrame:
    """Scaled to 0..1 within each row (``cell_id``) or column (``region``); 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    return matrix.withColumn("scaled", F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(F.lit(0.0)))


#: Cells of a list, about; up to how many cells all lists are broadcast, and copies of each list beyond that.
CELLS_PER_LIST, BROADCAST_CELLS, LIST_COPIES = 4096, 1_000_000, 64


def impute(matrix: DataFrame, cells: DataFrame, how: str = "mean", places: int | None = None) -> DataFrame:
    """Every (cell, covered region) with its mean, the missing ones from the region's mean, median, mode or 0, rounded if ``places`` is given.

    The dense matrix is the result asked for, but it is never shuffled: cells are dealt to lists, a region meets each
    list once, with the means it has there, and the rows are unfolded by the task that hands them out.
    """
    stat = {"mean": F.avg("mean"), "median": F.median("mean"), "most_frequent": F.mode("mean", deterministic=True), "constant": F.lit(0.0)}[how]
    told = lambda c: c if places is None else F.round(c, places)
    fill = matrix.groupBy("region").agg(told(stat).alias("fill"))
    ids = cells.select("cell_id").distinct()
    n = ids.count()
    lists = max(1, -(-n // CELLS_PER_LIST))
    place = F.pmod(F.xxhash64("cell_id"), F.lit(lists)).alias("_list")
    dealt = ids.groupBy(place).agg(F.sort_array(F.collect_list(F.struct("cell_id"))).getField("cell_id").alias("_cells"))
    own = F.struct("cell_id", told(F.col("mean")).alias("value"), F.lit(False).alias("imputed"))
    known = matrix.filter("mean IS NOT NULL").join(ids, "cell_id", "left_semi").groupBy(place, "region").agg(F.collect_list(own).alias("_known"))
    # in this order of keys the rows of a list follow each other, so that the column of cells repeats and packs well
    wide = fill.crossJoin(F.broadcast(dealt.select("_list"))).join(known, ["_list", "region"], "left")
    if n <= BROADCAST_CELLS:
        wide = wide.join(F.broadcast(dealt), "_list")
    else:
        copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(LIST_COPIES - 1))))
        wide = wide.withColumn("_copy", F.pmod(F.xxhash64("region"), F.lit(LIST_COPIES)).cast("int")).join(copies, ["_list", "_copy"])
    none = F.array().cast(known.schema["_known"].dataType)
    missing = F.array_except("_cells", F.coalesce(F.col("_known.cell_id"), F.array().cast(dealt.schema["_cells"].dataType)))
    filled = F.transform(missing, lambda c: F.struct(c.alias("cell_id"), F.col("fill").alias("value"), F.lit(True).alias("imputed")))
    return wide.select("region", F.explode(F.concat(F.coalesce("_known", none), filled)).alias("x")).select("x.cell_id", "region", "x.value", "x.imputed")


def pivoted(matrix: DataFrame, regions: list[str]) -> DataFrame:
    """A row a cell, a column for each region of a given list."""
    return matrix.groupBy("cell_id").pivot("region", regions).agg(F.first("mean"))


def without_chroms(sites: DataFrame, chroms: list[str]) -> DataFrame:
    return sites.filter(~F.col("chrom").isin(*chroms))


def hashed(key: Column) -> Column:
    """A fixed spread of integer keys over 32 bits, for samples that don't change from run to run."""
    return (key.cast("long") * 2654435761 + 12345) % 4294967296


def sample_fraction(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """About this share of the rows, the same ones every time."""
    return df.filter(hashed(F.col(key)) < int(fraction * 4294967296))


def sample_fixed(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same ones every time; a top-k, merged task by task."""
    return df.orderBy(hashed(F.col(key)), key).limit(n)


def window_level(sites: DataFrame, chrom: str, start: int, end: int, min_cov: int = 0) -> DataFrame:
    """Each cell's share of methylated sites in one window, of the unambiguous ones with enough coverage."""
    told = (F.col("state") != 0) & (F.col("cov") >= min_cov)
    value = F.when(told, F.when(F.col("state") == -1, 0).otherwise(F.col("state")))
    return sites.filter((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end)).groupBy("cell_id").agg(F.avg(value).alias("mean"))


def mean_over(matrix: DataFrame, regions: list[str]) -> DataFrame:
    """Each cell's mean over some regions, with how many of them it covers."""
    return matrix.filter(F.col("region").isin(*regions)).groupBy("cell_id").agg(F.count("mean").alias("n"), exact_moments("mean", 1000)[0].alias("mean"))


def average_coverage(reads: DataFrame, chrom_sizes: DataFrame, read_length: int) -> DataFrame:
    """reads * length / genome size of each cell."""
    size = chrom_sizes.agg(F.sum("length")).first()[0] or 0
    return reads.withColumn("coverage", F.when(F.lit(size) > 0, F.col("reads") * float(read_length) / F.lit(size)))


def length_report(regions: DataFrame, kind: str) -> DataFrame:
    """Per kind: number, mean, least and largest length."""
    length = F.col("end_pos") - F.col("start_pos")
    return regions.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_length"), F.min(length).alias("shortest"), F.max(length).alias("longest"))


def column_spread(matrix: DataFrame) -> DataFrame:
    """Per region, over the cells that cover it: mean, population variance, median and median absolute deviation."""
    middle = F.median("mean").over(Window.partitionBy("region"))
    mean, var = exact_moments("mean", 1000)
    mad = F.median(F.abs(F.col("mean") - F.col("_middle")))
    return matrix.withColumn("_middle", middle).groupBy("region").agg(mean.alias("mean"), var.alias("var"), F.max("_middle").alias("median"), mad.alias("mad"))


def within(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows within the bounds of each column, both included; a bound of None or 0 is none."""
    ok = F.lit(True)
    for c, (low, high) in bounds.items():
        if low:
            ok = ok & (F.col(c) >= low)
        if high:
            ok = ok & (F.col(c) <= high)
    return df.filter(ok)


def pass_rates(df: DataFrame, above: dict[str, float], below: dict[str, float]) -> DataFrame:
    """metric, passed, total, rate: how many rows are strictly above or below each cut-off, in one pass."""
    tests = [(c, F.col(c) > x) for c, x in above.items()] + [(c, F.col(c) < x) for c, x in below.items()]
    one = df.agg(F.count(F.lit(1)).alias("total"), F.array(*[F.struct(F.lit(c).alias("metric"), F.count_if(t).alias("passed")) for c, t in tests]).alias("m"))
    each = one.select("total", F.inline("m"))
    return each.select("metric", "passed", "total", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).alias("rate"))


def require_rates(rates: DataFrame, least: float = 0.6) -> None:
    """An error if a cut-off is passed by this share of the rows or less."""
    bad = sorted(r["metric"] for r in rates.filter(F.coalesce(F.col("rate") <= least, F.lit(True))).collect())
    if bad:
        raise ValueError(f"too few rows pass the cut-offs of {', '.join(bad)}; check them or the data's quality")

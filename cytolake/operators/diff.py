"""Differential methylation between groups of cells, by grouped moments and ranks.

A region's values of all cells meet in one task for the ranks; there are as many
as cells, so the work is dealt by region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(matrix: DataFrame, cells: DataFrame, group: str = "cell_type") -> DataFrame:
    return matrix.join(cells.select("cell_id", F.col(group).alias("grp")), "cell_id").select("region", "cell_id", "grp", F.col("mean").alias("x"))


def group_moments(rows: DataFrame) -> DataFrame:
    """Per region and group: n, sum and sum of squares of the group (1) and of all others (2)."""
    own = rows.groupBy("region", "grp").agg(F.count("x").alias("n1"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("q1"))
    w = Window.partitionBy("region")
    return own.withColumns({f"{k}2": F.sum(f"{k}1").over(w) - F.col(f"{k}1") for k in ("n", "s", "q")})


def _variance(n: str, s: str, q: str) -> Column:
    return F.when(F.col(n) > 1, (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1))


def t_test(rows: DataFrame, overestimate: bool = True) -> DataFrame:
    """Welch statistic of each group against the rest; the rest's variance is divided by the group's size if overestimated."""
    m = group_moments(rows).withColumns({"m1": F.col("s1") / F.col("n1"), "m2": F.when(F.col("n2") > 0, F.col("s2") / F.col("n2")), "v1": _variance("n1", "s1", "q1"), "v2": _variance("n2", "s2", "q2")})
    error = F.sqrt(F.greatest(F.col("v1") / F.col("n1") + F.col("v2") / (F.col("n1") if overestimate else F.col("n2")), F.lit(0.0)))
    return m.withColumn("t", F.when(error > 1e-9, (F.col("m1") - F.col("m2")) / error))


def fold_change(rows: DataFrame) -> DataFrame:
    """Ratio of the group's mean to the rest's, and log2 ratio of their expm1."""
    m = t_test(rows)
    lfc = F.log2((F.expm1("m1") + 1e-9) / (F.expm1("m2") + 1e-9))
    return m.select("region", "grp", F.when(F.col("m2") > 0, F.col("m1") / F.col("m2")).alias("fc"), lfc.alias("lfc"))


def rank_sums(rows: DataFrame) -> DataFrame:
    """Rank sum of each group among all cells of the region, ties averaged."""
    order = Window.partitionBy("region").orderBy("x")
    tie = Window.partitionBy("region", "x")
    ranked = rows.withColumn("r", F.rank().over(order) + (F.count(F.lit(1)).over(tie) - 1) / 2)
    own = ranked.groupBy("region", "grp").agg(F.count(F.lit(1)).alias("n1"), F.sum("r").alias("r1"))
    return own.withColumn("n", F.sum("n1").over(Window.partitionBy("region")))


def wilcoxon(rows: DataFrame) -> DataFrame:
    """z of the rank-sum test (no tie correction) and the area under the curve."""
    s = rank_sums(rows).withColumn("n2", F.col("n") - F.col("n1")).filter("n2 > 0")
    z = (F.col("r1") - F.col("n1") * (F.col("n") + 1) / 2) / F.sqrt(F.col("n1") * F.col("n2") * (F.col("n") + 1) / 12)
    auc = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n2"))
    return s.select("region", "grp", "n1", "n2", z.alias("z"), auc.alias("auc"))


def cosg(rows: DataFrame, mu: float = 1.0) -> DataFrame:
    """Cosine marker score of each region for each group; missing values count as 0."""
    size = rows.select("cell_id", "grp").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    own = rows.groupBy("region", "grp").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).join(F.broadcast(size), "grp")
    w = Window.partitionBy("region")
    c = own.withColumn("c", F.when(F.sum("q").over(w) > 0, F.col("s") / F.sqrt(F.sum("q").over(w) * F.col("size"))).otherwise(F.lit(0.0)))
    below = (1 - mu) * F.col("c") * F.col("c") + mu * F.sum(F.col("c") * F.col("c")).over(w)
    return c.withColumn("score", F.when(below > 0, F.pow("c", 3) / below).otherwise(F.lit(0.0))).select("region", "grp", "c", "score")


def top_per_group(scored: DataFrame, n: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("grp").orderBy(F.desc(by), "region")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def bh_adjust(rows: DataFrame, p: str, group: str | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each group."""
    parts = [group] if group else []
    up = Window.partitionBy(*parts).orderBy(F.asc(p))
    down = Window.partitionBy(*parts).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.count(p).over(Window.partitionBy(*parts))
    top = F.max("_row").over(Window.partitionBy(*parts, p))
    ranked = rows.withColumn("_row", F.row_number().over(up)).withColumn("_row", top)
    return ranked.withColumn("_q", F.col(p) * m / F.col("_row")).withColumn("padj", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_q", "_row")


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal statistic, by a rational approximation of the error function (error below 1.5e-7)."""
    # fixed values: the coefficients of the published approximation
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / 2.0**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))

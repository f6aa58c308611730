"""Result tables of differential tests: ranked, filtered, by direction, between two groups, one against the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .diff import bh_adjust, fold_change, normal_p, t_test, wilcoxon

#: Decimal places that statistics are compared with, so that ties stay ties in any order of summation.
PLACES = 9


def ranked_result(rows: DataFrame) -> DataFrame:
    """region, grp, z, p, padj (within the group), lfc, and the rank by z among the group's regions."""
    z = wilcoxon(rows).withColumn("z", F.round("z", PLACES))
    told = bh_adjust(z.withColumn("p", F.round(normal_p(F.col("z")), PLACES)), "p", "grp")
    lfc = fold_change(rows).select("region", "grp", F.round("lfc", PLACES).alias("lfc"))
    order = Window.partitionBy("grp").orderBy(F.desc("z"), "region")
    return told.join(lfc, ["region", "grp"]).withColumn("rank", F.row_number().over(order).cast("long")).select("region", "grp", "z", "p", "padj", "lfc", "rank")


def filtered(result: DataFrame, max_padj: float | None = None, min_lfc: float | None = None, max_lfc: float | None = None) -> DataFrame:
    """Rows strictly within the bounds (None: no bound)."""
    ok = F.lit(True)
    for c, bound, below in (("padj", max_padj, True), ("lfc", min_lfc, False), ("lfc", max_lfc, True)):
        if bound is not None:
            ok = ok & (F.col(c) < bound if below else F.col(c) > bound)
    return result.filter(ok)


def directed(result: DataFrame, direction: str = "both") -> DataFrame:
    """Rows that go up, down, or any for another word."""
    return result.filter({"up": F.col("lfc") > 0, "down": F.col("lfc") < 0}.get(direction, F.lit(True)))


def pairwise_test(rows: DataFrame, group: str, reference: str) -> DataFrame:
    """t statistic and rank-sum z of one group against another, all other cells left out."""
    if group == reference:
        raise ValueError("a group is not compared with itself")
    two = rows.filter(F.col("grp").isin(group, reference))
    t = t_test(two, overestimate=False).filter(F.col("grp") == group).select("region", "n1", "n2", "m1", "m2", "t")
    return t.join(wilcoxon(two).filter(F.col("grp") == group).select("region", "z"), "region")


def one_vs_rest(rows: DataFrame, max_fc: float, min_auroc: float) -> DataFrame:
    """region, grp, fc and auroc of the regions below a fold change and above an area, either side of one half."""
    area = wilcoxon(rows).select("region", "grp", (F.abs(F.col("auc") - 0.5) + 0.5).alias("auroc"))
    both = fold_change(rows).select("region", "grp", "fc").join(area, ["region", "grp"])
    return both.filter((F.col("fc") < max_fc) & (F.col("auroc") > min_auroc))


def group_tables(result: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The first n rows of each named group's table, one table after another."""
    parts = [result.filter((F.col("grp") == g) & (F.col("rank") <= n)) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def least_over_groups(result: DataFrame, key: str, p: str, below: float) -> DataFrame:
    """Keys whose smallest p-value over all groups is below a bound."""
    return result.groupBy(key).agg(F.min(p).alias(p)).filter(F.col(p) < below)


def region_genes(regions: DataFrame, genes: DataFrame, upper: bool = False) -> DataFrame:
    """Each region's distinct gene names, sorted; regions without any are left out.  Both sides have key columns ``region`` and ``gene_name``."""
    name = F.upper("gene_name") if upper else F.col("gene_name")
    named = regions.join(genes, "gene_id").filter(F.col("gene_name").isNotNull()).select("region", name.alias("gene_name")).distinct()
    return named.groupBy("region").agg(F.array_join(F.sort_array(F.collect_list("gene_name")), ";").alias("genes"), F.count(F.lit(1)).alias("n_genes"))


def by_list(df: DataFrame, key: str, wanted: list[str], spark: SparkSession) -> DataFrame:
    """Rows whose key is in a list, with its place there."""
    listed = spark.createDataFrame([(k, n) for n, k in enumerate(dict.fromkeys(wanted))], f"{key} string, place long")
    return df.join(F.broadcast(listed), key)


def global_rank(df: DataFrame, save, *order: str) -> DataFrame:
    """``df`` with ``rank``, 1 for the first row of the whole table.

    Rows are dealt by ranges of the order and numbered within them; a range's
    first number is the count of all rows before it.  Only the counts of ranges
    (one a task) meet in one place.  ``save`` writes a table and reads it again.
    """
    dealt = save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(sizes), "_range").withColumn("rank", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def correlations(rows: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Pearson correlation of each two columns over the rows that both have, by sums; there are few columns (groups)."""
    a = rows.select(F.col(row), F.col(column).alias("a"), F.col(value).alias("x"))
    b = rows.select(F.col(row), F.col(column).alias("b"), F.col(value).alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = a.join(b, row).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}.items()])
    n = F.col("n")
    below = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return sums.select("a", "b", "n", F.when(below > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / below).alias("r"))


def beta_moments(matrix: DataFrame, least: float = 1e-12) -> DataFrame:
    """region, alpha, beta: parameters of the beta distribution with the region's mean and population variance.

    Null where there is none: a variance up to ``least``, or not below mean * (1 - mean), which holds where all means are 0 or 1.
    Means have three places and are taken as thousandths, so that sums are integers and no order of rows shows.
    """
    whole = lambda c: c.cast("decimal(19,0)")
    k = F.floor(F.col("mean") * 1000.0 + 0.5)
    sums = matrix.filter("mean IS NOT NULL").groupBy("region").agg(F.count("mean").alias("n"), F.sum(k).alias("total"), F.sum(k * k).alias("squares"))
    n, total, squares = (whole(F.col(c)) for c in ("n", "total", "squares"))
    spread = ((n * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")).cast("double")
    room = whole(F.col("total") * 1000 - F.col("squares"))
    told = (room > 0) & (spread / (F.col("n").cast("double") * F.col("n") * 1e6) > least)
    of = lambda part: F.when(told, (part * room).cast("double") / (spread * 1000.0))
    return sums.select("region", of(total).alias("alpha"), of(whole(F.col("n") * 1000 - F.col("total"))).alias("beta"))


def intergenic_names(features: DataFrame, save, name: str, *order: str) -> DataFrame:
    """``features`` with the name intergenic_0, intergenic_1, ... for those whose ``feature`` is intergenic, in the given order."""
    inter = F.col("feature") == "intergenic"
    numbered = global_rank(features.filter(inter), save, *order)
    fresh = numbered.withColumn(name, F.concat(F.lit("intergenic_"), (F.col("rank") - 1).cast("string"))).drop("rank")
    return features.filter(~F.coalesce(inter, F.lit(False))).unionByName(fresh)

"""Plot-ready tables: compositions, proportions, medians, histograms, curves, layouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranked import global_rank


def composition(cells: DataFrame, group: str, color: str) -> DataFrame:
    """Cells by group and colour, zero filled, long form."""
    counts = cells.groupBy(group, color).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select(group).distinct().join(cells.select(color).distinct())  # few categories each
    return grid.join(counts, [group, color], "left").select(group, color, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def proportions(cells: DataFrame, group: str, color: str) -> DataFrame:
    counts = cells.groupBy(group, color).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def group_quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    q = F.percentile(value, [0.25, 0.5, 0.75])
    out = rows.groupBy(group).agg(F.count(value).alias("n"), q.alias("q"))
    return out.select(group, "n", *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)])


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pass_curve(rows: DataFrame, save, value: str, key: str) -> DataFrame:
    """Percentage of rows that pass a cut-off at each row's value: 100 * (1 - rank / n); ``save`` writes a table and reads it again."""
    ranked = global_rank(rows.select(key, value), save, value, key)
    n = ranked.count()
    return ranked.select(key, value, (100 * (1 - F.col("rank") / float(max(n, 1)))).alias("pass_pct"))


def centroids(rows: DataFrame, label: str, x: str, y: str) -> DataFrame:
    return rows.groupBy(label).agg(F.median(x).alias("x"), F.median(y).alias("y"))


def equal_width(value: Column, low: float, high: float, n: int = 7) -> Column:
    """Category 1..n of equal widths."""
    return F.least(F.lit(n), F.greatest(F.lit(1), F.floor((value - low) / ((high - low) / n)) + 1)).cast("int")


def elbow(rows: DataFrame, order: str, value: str, saturation: float = 0.01) -> DataFrame:
    """One row: the first place whose step is below a share of the steps so far."""
    w = Window.orderBy(order)
    steps = rows.withColumn("_gap", F.lag(value).over(w) - F.col(value)).withColumn("_all", F.sum("_gap").over(w))
    return steps.filter(F.col("_gap") < saturation * F.col("_all")).agg(F.min(order).alias("elbow"))


def pack_rows(genes: DataFrame, gap: int = 5000) -> DataFrame:
    """Drawing line of each gene, by descending start on the first line with room; one chromosome a task."""

    def lay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_pos", "end_pos", "gene_id"], ascending=[False, True, True])
        lines: list[int] = []  # leftmost start on each line
        place = []
        for start, end in zip(rows["start_pos"], rows["end_pos"], strict=True):
            line = next((k for k, left in enumerate(lines) if end + gap <= left), len(lines))
            if line == len(lines):
                lines.append(start)
            else:
                lines[line] = start
            place.append(line)
        return rows[["chrom", "gene_id"]].assign(line=place)

    return genes.select("chrom", "gene_id", "start_pos", "end_pos").groupBy("chrom").applyInPandas(lay, "chrom string, gene_id string, line long")

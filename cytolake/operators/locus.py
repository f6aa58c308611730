"""One locus: its gene models, and the smoothed profile of its sites by group of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import smooth


def label_place(start: Column, end: Column, low: int, high: int) -> tuple[Column, Column]:
    """Position and place of a gene's label in a view [low, high]: in the middle of what is seen, or at the end that is."""
    over, inside = (start <= low) & (end >= high), (start >= low) & (end <= high)
    x = F.when(over, F.lit((low + high) / 2)).when(inside, (start + end) / 2).when(start >= low, start.cast("double")).otherwise(end.cast("double"))
    return x, F.when(over | inside, "top center").when(start >= low, "top right").otherwise("top left")


def gene_models(features: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """Per gene (``name (type)``) of a locus: ends, length, strand, label, and its merged exons as ``start-end;...``.

    ``features`` has chrom, feature (gene or exon), start_pos, end_pos, strand,
    gene_name and gene_type.  Features that meet [low, high] count; genes
    without a gene row there are left out, of several gene rows that which
    begins last counts; exons that touch are one.
    """
    near = features.filter((F.col("chrom") == chrom) & (F.col("start_pos") <= high) & (F.col("end_pos") >= low))
    near = near.withColumn("gene", F.concat("gene_name", F.lit(" ("), "gene_type", F.lit(")")))
    order = Window.partitionBy("gene").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    exons = near.filter("feature = 'exon'").withColumn("new", F.when(reach >= F.col("start_pos"), 0).otherwise(1))
    exons = exons.withColumn("block", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = exons.groupBy("gene", "block").agg(F.min("start_pos").alias("a"), F.max("end_pos").alias("b"))
    listed = merged.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ";")
    genes = near.filter("feature = 'gene'").groupBy("gene").agg(F.max(F.struct("start_pos", "end_pos", "strand")).alias("g")).select("gene", "g.*")
    x, place = label_place(F.col("start_pos"), F.col("end_pos"), low, high)
    return genes.join(listed.select("gene", text.alias("exons")), "gene", "left").select(
        "gene", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos")).alias("length"), "strand", x.alias("label_x"), place.alias("label_place"), F.coalesce("exons", F.lit("")).alias("exons")
    )


def profile(sites: DataFrame, cells: DataFrame, group: str, clusters: list[str], chrom: str, low: int, high: int, bandwidth: int = 300, margin: int = 3000) -> DataFrame:
    """(cluster, pos, value): the share of methylated cells along a locus and its margins, smoothed within each cluster.

    With one cluster all other cells are the second one, ``Others``.  Null where
    the kernel would reach over an end of the covered part.
    """
    origin = max(0, low - margin)
    near = sites.filter((F.col("chrom") == chrom) & (F.col("pos") >= origin) & (F.col("pos") <= high + margin))
    own = F.when(F.col(group).isin(*clusters), F.col(group))
    named = cells.select("cell_id", (F.coalesce(own, F.lit("Others")) if len(clusters) < 2 else own).alias("cluster")).filter("cluster IS NOT NULL")
    part = near.join(named, "cell_id").select(F.col("cluster").alias("chrom"), (F.col("pos") - origin).alias("pos"), "state")
    smoothed = smooth.null_edges(smooth.tricube_smooth(smooth.fractions(part), bandwidth), bandwidth)
    return smoothed.select(F.col("chrom").alias("cluster"), (F.col("pos") + origin).alias("pos"), "value")

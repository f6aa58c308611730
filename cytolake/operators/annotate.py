"""Genes and genomic features of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .axis import overlap_join

#: The order in which a region's features are resolved.
PRIORITY = ("promoter(1-5kb)", "promoter(<=1kb)", "five_prime_utr", "three_prime_utr", "exon", "intron", "downstream", "gene", "promoter")
#: Feature names of other annotations.
FEATURE_NAMES = {"5UTR": "five_prime_utr", "3UTR": "three_prime_utr"}


def genes_of_regions(regions: DataFrame, genes: DataFrame, upstream: int = 3000, bin_width: int = 1000) -> DataFrame:
    """Region and the ids of the genes that it meets, each gene extended upstream of its strand's start."""
    wide = genes.withColumns(
        {
            "start_pos": F.when(F.col("strand") == "+", F.col("start_pos") - upstream).otherwise(F.col("start_pos")),
            "end_pos": F.when(F.col("strand") == "-", F.col("end_pos") + upstream).otherwise(F.col("end_pos")),
        }
    )
    found = overlap_join(regions.select("region", "chrom", "start_pos", "end_pos"), wide.select("gene_id", "chrom", "start_pos", "end_pos"), bin_width)
    named = found.groupBy("region").agg(F.array_join(F.sort_array(F.collect_set("other_gene_id")), ";").alias("genes"))
    return regions.select("region").join(named, "region", "left").select("region", F.coalesce("genes", F.lit("intergenic")).alias("genes"))


def promoters(genes: DataFrame, near: int = 1000, far: int = 5000, downstream: int = 1000) -> DataFrame:
    """Promoter and downstream intervals around each gene's start and end, along its strand."""
    plus = F.col("strand") != "-"
    tss = F.when(plus, F.col("start_pos")).otherwise(F.col("end_pos"))
    tes = F.when(plus, F.col("end_pos")).otherwise(F.col("start_pos"))

    def window(name: str, anchor: Column, a: int, b: int) -> Column:
        """From a to b along the strand, counted from the anchor (negative: upstream)."""
        lo = F.when(plus, anchor + a).otherwise(anchor - b)
        hi = F.when(plus, anchor + b).otherwise(anchor - a)
        return F.struct(F.lit(name).alias("feature"), F.greatest(lo, F.lit(1)).cast("long").alias("start_pos"), F.greatest(hi, F.lit(0)).cast("long").alias("end_pos"))

    made = F.array(window("promoter(<=1kb)", tss, -near, -1), window("promoter(1-5kb)", tss, -far, -near - 1), window("downstream", tes, 1, downstream))
    out = genes.select("gene_id", "chrom", "strand", F.explode(made).alias("f")).select("gene_id", "chrom", "strand", "f.feature", "f.start_pos", "f.end_pos")
    return out.filter("start_pos <= end_pos")


def introns(exons: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """Gaps between a transcript's consecutive exons."""
    w = Window.partitionBy(transcript).orderBy("start_pos")
    gap = exons.withColumn("_next", F.lead("start_pos").over(w)).filter(F.col("_next") > F.col("end_pos") + 1)
    return gap.withColumns({"start_pos": F.col("end_pos") + 1, "end_pos": F.col("_next") - 1}).drop("_next")


def resolve(regions: DataFrame, features: DataFrame, order: tuple[str, ...] = PRIORITY, bin_width: int = 1000) -> DataFrame:
    """Each region's feature that comes first in the order, with the genes that have it; else distal intergenic."""
    found = overlap_join(regions.select("region", "chrom", "start_pos", "end_pos"), features.select("gene_id", "feature", "chrom", "start_pos", "end_pos"), bin_width)
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("other_feature"))
    ranked = found.withColumn("rank", rank).filter("rank > 0").groupBy("region", "rank", F.col("other_feature").alias("feature"))
    ranked = ranked.agg(F.array_join(F.sort_array(F.collect_set("other_gene_id")), ",").alias("genes"))
    best = ranked.groupBy("region").agg(F.min(F.struct("rank", "feature", "genes")).alias("b"))
    return regions.select("region").join(best, "region", "left").select(
        "region", F.coalesce("b.feature", F.lit("Distal intergenic")).alias("feature"), F.coalesce("b.genes", F.lit("")).alias("genes")
    )

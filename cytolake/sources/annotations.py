"""Readers of regions, genes, chromosome sizes, gene sets, sequences and sparse triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("track"))
    return lines.select(F.split("value", sep).alias("f"))


def bed(spark: SparkSession, path: str, keep: int = 0) -> DataFrame:
    """chrom, start_pos, end_pos, region, without repeated rows; the name defaults to chrom:start-end.

    ``keep`` more columns follow as extra_1, ...; a line without two numbers is an error.
    """
    f = _fields(spark, path, r"\s+").withColumns({"chrom": F.col("f")[0], "start_pos": F.col("f")[1].cast("long"), "end_pos": F.col("f")[2].cast("long")})
    name = F.coalesce(F.get("f", F.lit(3)), F.concat("chrom", F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string")))
    extra = [F.get("f", F.lit(4 + k)).alias(f"extra_{k + 1}") for k in range(keep)]
    return f.select("chrom", "start_pos", "end_pos", name.alias("region"), *extra).distinct()


def load_regions(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Regions by the file's ending; only bed is known."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind != "bed":
        raise ValueError(f"unknown region format {kind!r}")
    return bed(spark, path)


def attribute(attributes: Column, key: str) -> Column:
    """Value of ``key "value";`` or ``key=value`` in an attribute text; null without it."""
    quoted = F.regexp_extract(attributes, rf'(?:^|;)\s*{key} "([^"]*)"', 1)
    plain = F.regexp_extract(attributes, rf"(?:^|;)\s*{key}=([^;]*)", 1)
    return F.nullif(F.coalesce(F.nullif(quoted, F.lit("")), plain), F.lit(""))


def gtf(spark: SparkSession, path: str, feature: str | None = "gene", gene_type: str | None = "protein_coding", add_chr: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a GTF or GFF file: chrom, feature, start, end (1-based, closed), strand and gene attributes."""
    f = _fields(spark, path, "\t").filter(F.size("f") >= 9)
    a = F.col("f")[8]
    chrom = F.when(F.col("f")[0].startswith("chr"), F.col("f")[0]).otherwise(F.concat(F.lit("chr"), F.col("f")[0])) if add_chr else F.col("f")[0]
    out = f.select(
        chrom.alias("chrom"), F.col("f")[2].alias("feature"), F.col("f")[3].cast("long").alias("start_pos"), F.col("f")[4].cast("long").alias("end_pos"), F.col("f")[6].alias("strand"),
        attribute(a, "gene_id").alias("gene_id"), attribute(a, "gene_name").alias("gene_name"), F.coalesce(attribute(a, "gene_type"), attribute(a, "gene_biotype")).alias("gene_type"),
        attribute(a, "transcript_id").alias("transcript_id"),
    )
    if feature:
        out = out.filter(F.col("feature") == feature)
    if gene_type and gene_type != "all":
        out = out.filter(F.col("gene_type") == gene_type)
    return out.filter(~F.col("chrom").isin(*exclude)) if exclude else out


def tss_windows(genes: DataFrame, up: int, down: int) -> DataFrame:
    """Genes as windows around their strand's start."""
    plus = F.col("strand") != "-"
    start = F.when(plus, F.greatest(F.lit(1).cast("long"), F.col("start_pos") - up)).otherwise(F.col("end_pos") - down)
    end = F.when(plus, F.col("start_pos") + down).otherwise(F.col("end_pos") + up)
    return genes.withColumns({"start_pos": start, "end_pos": end})


def chrom_sizes(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    out = _fields(spark, path, "\t").select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("length"))
    return out.filter(~F.col("chrom").isin(*exclude)) if exclude else out


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene) of a gene-set file: a term, a description, and its genes on each line."""
    if not path.endswith(".gmt"):
        raise ValueError("gene sets are read from .gmt files")
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") > 2)
    out = f.select(F.col("f")[0].alias("term"), F.explode(F.slice("f", 3, 1 << 30)).alias("gene_id"))
    return out.select("term", F.trim(F.split("gene_id", ",")[0]).alias("gene_id")).filter("gene_id <> ''").distinct()


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, sequence): a record a sequence."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.split("value", "\n", 2)
    return records.select(F.split(head[0], r"\s+")[0].alias("chrom"), F.regexp_replace(F.get(head, F.lit(1)), r"\s", "").alias("sequence"))


def region_sequences(sequences: DataFrame, regions: DataFrame) -> DataFrame:
    """Sequence of each region (1-based, closed), upper case."""
    return regions.join(sequences, "chrom").withColumn("sequence", F.upper(F.expr("substring(sequence, start_pos, end_pos - start_pos + 1)")))


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a MatrixMarket file, counted from 1; the size line is left out."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("n"))
    first = rows.agg(F.min("n")).first()[0]
    body = rows.filter(F.col("n") != first)
    return body.select(F.col("f")[0].cast("long").alias("row"), F.col("f")[1].cast("long").alias("column"), F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))


def meta_values(spark: SparkSession, path: str, column: str = "sample", sep: str = ",") -> DataFrame:
    """The distinct values of a column of a metadata file with a header."""
    return spark.read.csv(path, header=True, sep=sep).select(column).distinct()

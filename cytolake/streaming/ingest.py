"""Streaming ingest of coverage files: an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sites import is_cg, ratio, trinarise

SCHEMA = "cell_name string, chrom string, pos long, meth long, unmeth long, context string"


def site_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Sites of coverage tables (tab separated) as their files arrive in a folder."""
    rows = spark.readStream.schema(SCHEMA).option("sep", "\t").option("maxFilesPerTrigger", files_per_trigger).csv(path)
    cov = F.col("meth") + F.col("unmeth")
    cg = rows.filter(is_cg(F.col("context")) & (cov > 0))
    return cg.select("cell_name", "chrom", "pos", "meth", cov.alias("cov"), trinarise(ratio(F.col("meth"), cov)).alias("state"))


def qc_stream(sites: DataFrame) -> DataFrame:
    """Running per-cell quality figures, for the update or complete output mode."""
    return sites.groupBy("cell_name").agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("state") == 1).alias("meth"), F.sum("cov").alias("n_total"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean value of events by type and tumbling window, with a watermark for late ones."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")

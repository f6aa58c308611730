"""Writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions that stay together in a file.
BLOCK = 10_000_000


def write_sites(sites: DataFrame, path: str) -> None:
    """Sites by chromosome folder, dealt and sorted by position block, so a long chromosome is many files."""
    dealt = sites.withColumn("_block", F.floor(F.col("pos") / BLOCK)).repartition("chrom", "_block")
    dealt.sortWithinPartitions("chrom", "pos", "cell_id").drop("_block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(path)


def write_track(track: DataFrame, path: str) -> None:
    track.repartition("chrom").sortWithinPartitions("pos").write.mode("overwrite").partitionBy("chrom").csv(path)


def write_matrix(matrix: DataFrame, cells: DataFrame, regions: DataFrame, path: str) -> None:
    """The star schema: matrix, cells and regions side by side."""
    for name, df in (("matrix", matrix), ("cells", cells), ("regions", regions)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_matrix(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("matrix", "cells", "regions"))

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in tests.
ONE_MACHINE = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (named or ONE_MACHINE).rstrip("/")


def saver(spark: SparkSession, name: str):
    """A function that writes a table of this run and reads it again, which cuts its lineage."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{table}")
        return spark.read.schema(df.schema).parquet(f"{root}/{table}")

    return save

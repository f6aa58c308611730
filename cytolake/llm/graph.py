"""Connected components of an edge table, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """(id, root): the smallest id reachable from each id that occurs in ``edges`` (src, dst).

    Each round gives a node the smallest label among its own and its
    neighbours', then follows the labels once more (pointer jumping), so a
    chain of n nodes takes about log n rounds.  Groups are reduced by partial
    aggregation before the shuffle; no list of neighbours is ever built.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = stage.save(both, f"{name}_edges")
    labels = stage.save(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("id"), F.min("dst")).alias("root")), f"{name}_0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        lower = lower.join(hop, "root", "left").select("id", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        fresh = stage.save(lower, f"{name}_{turn}")
        changed = fresh.filter("old <> root").limit(1).count()
        stage.drop(f"{name}_{turn - 1}")
        labels = fresh.select("id", "root")
        if not changed:
            return labels

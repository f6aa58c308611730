"""Logical inputs (sites, cells, regions, genes, ...) as views over plain tables.

The view texts use only syntax that Spark SQL and DuckDB share, so a query and
its oracle start from the same rows.  ``{table}`` stands for a table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "sites_raw": """SELECT CAST(l_suppkey AS INT) AS cell_id, concat('chr', CAST(l_linenumber AS STRING)) AS chrom, CAST(l_partkey AS BIGINT) AS pos,
  CASE CAST(floor(l_discount * 100 + 0.5) AS INT) % 5 WHEN 0 THEN CAST(l_quantity AS INT) WHEN 1 THEN CAST(l_quantity AS INT)
    WHEN 4 THEN CAST(floor(l_quantity / 2) AS INT) ELSE 0 END AS meth,
  CAST(l_quantity AS INT) AS cov, CASE l_returnflag WHEN 'R' THEN 'CHH' WHEN 'N' THEN 'CGA' ELSE 'CG' END AS context,
  CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand FROM {lineitem}""",
    "sites": """SELECT cell_id, chrom, pos, CAST(sum(meth) AS BIGINT) AS meth, CAST(sum(cov) AS BIGINT) AS cov,
  CASE WHEN CAST(sum(meth) AS DOUBLE) / CAST(sum(cov) AS DOUBLE) >= CAST(0.9 AS DOUBLE) THEN 1
    WHEN CAST(sum(meth) AS DOUBLE) / CAST(sum(cov) AS DOUBLE) <= CAST(0.1 AS DOUBLE) THEN -1 ELSE 0 END AS state
  FROM {sites_raw} WHERE context LIKE 'CG%' GROUP BY cell_id, chrom, pos""",
    "cells": """SELECT CAST(s_suppkey AS INT) AS cell_id, s_name AS cell_name, r_name AS cell_type, n_name AS sample, s_acctbal AS score
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "chrom_sizes": "SELECT chrom, max(pos) + 1 AS length FROM {sites_raw} GROUP BY chrom",
    "regions": """SELECT concat('r', CAST(p_partkey AS STRING)) AS region, concat('chr', CAST(p_partkey % 7 + 1 AS STRING)) AS chrom,
  p_partkey + 1 AS start_pos, p_partkey + p_size AS end_pos, p_type AS kind FROM {part}""",
    "genes": """SELECT concat('G', CAST(p_partkey AS STRING)) AS gene_id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS gene_name,
  concat('chr', CAST(p_partkey % 7 + 1 AS STRING)) AS chrom, p_partkey + 1 AS start_pos, p_partkey + 2 * p_size AS end_pos,
  CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN p_size % 3 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS gene_type
  FROM {part} WHERE p_partkey % 37 = 0""",
    "gene_sets": "SELECT p_brand AS term, concat('G', CAST(p_partkey AS STRING)) AS gene_id FROM {part}",
    "motif_hits": """SELECT concat('r', CAST(l_partkey AS STRING)) AS region, concat('M', CAST(l_suppkey % 20 AS STRING)) AS motif_id,
  max(l_quantity) AS score FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_partkey, l_suppkey % 20""",
    "cluster_labels": "SELECT doc_id AS item_id, quality AS label_true, toxic AS label_pred FROM {labels}",
    "signal": "SELECT event_type AS chrom, event_id AS pos, value AS value FROM {events}",
}
NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or the table of this name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: view(spark, sf_dir, n) for n in dict.fromkeys(NAME.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **parts)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that ``{name}`` asks for as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in NAME.findall(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda text: NAME.sub(r"\1", text)
    heads = [f"{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        heads.append(body[5:])
        return "WITH " + ",\n".join(heads)
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body

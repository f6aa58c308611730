"""Queries on de-novo regions, differences, annotation, enrichment, sets, distances, clusters and plot tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, axis, cluster, denovo, diff, embed, enrich, logistic_pca, matrix, smooth, views
from .core import FRACTION, M, SMOOTH, TILE, TILED, r6, tiled
from .fixtures import view, with_views
from .tables import saver

QUERIES, ORACLE = {}, {}
WIDTH, STEP = 60, 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


DENOVO = f"""SELECT chrom, c - {WIDTH // 2} AS start_pos, c + {WIDTH // 2} AS end_pos, avg(m) AS mean, var_pop(m) AS var, count(*) AS n_cells FROM (
  SELECT s.chrom, c, cell_id, CAST(count(*) FILTER (WHERE state = 1) AS DOUBLE) / count(*) AS m FROM (SELECT chrom, unnest(range(min(pos) + {WIDTH // 2 + 1}, max(pos) - {WIDTH // 2 + 1}, {STEP})) AS c FROM {{sites}} GROUP BY chrom) w
  JOIN {{sites}} s ON s.chrom = w.chrom AND s.pos >= c - {WIDTH // 2 + 1} AND s.pos < c + {WIDTH // 2 - 1} GROUP BY s.chrom, c, cell_id) GROUP BY chrom, c"""
OUT = f"SELECT * FROM (SELECT *, avg(var) OVER (PARTITION BY chrom) AS mu, stddev_pop(var) OVER (PARTITION BY chrom) AS sd FROM ({DENOVO})) WHERE var < mu - 1.5 * sd OR var > mu + 1.5 * sd"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denovo.sliding_windows(view(spark, sf_dir, "sites"), WIDTH, STEP)


@query(f"SELECT chrom, start_pos, end_pos, round(mean, 6) AS mean, round(var + 1e-9, 6) AS var, n_cells FROM ({DENOVO})")
def win_denovo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("chrom", "start_pos", "end_pos", r6(F.col("mean"), "mean"), r6(F.col("var") + 1e-9, "var"), "n_cells")


@query(f"SELECT chrom, start_pos, end_pos, n_cells FROM ({OUT})")
def win_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denovo.outliers(windows(spark, sf_dir), 1.5).select("chrom", "start_pos", "end_pos", "n_cells")


def merged_sql(source: str) -> str:
    return f"""WITH i AS ({source}), a AS (SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM i),
b AS (SELECT *, sum(CASE WHEN so_far IS NULL OR start_pos > so_far THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_merged FROM b GROUP BY chrom, island"""


@query(merged_sql(f"SELECT chrom, start_pos, end_pos FROM ({OUT})"))
def win_merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.merge_intervals(denovo.outliers(windows(spark, sf_dir), 1.5).select("chrom", "start_pos", "end_pos"))


PER_CELL = "SELECT concat(chrom, '/', CAST(cell_id AS STRING)) AS chrom, pos FROM {sites}"
GAPS = f"""SELECT chrom, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_sites FROM (SELECT *, sum(CASE WHEN pos - p > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos) AS run
  FROM (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS p FROM ({PER_CELL}))) GROUP BY chrom, run HAVING count(*) >= 2"""


@query(GAPS)
def win_gap_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_cell = view(spark, sf_dir, "sites").select(F.concat("chrom", F.lit("/"), F.col("cell_id").cast("string")).alias("chrom"), "pos")
    return axis.gap_regions(per_cell, 60)


TILES = f"SELECT chrom, CAST(s AS BIGINT) AS start_pos, least(s + {TILE - 1}, length) AS end_pos FROM (SELECT chrom, length, unnest(range(1, length + 1, {TILE})) AS s FROM {{chrom_sizes}})"
METRICS = f"""SELECT chrom, start_pos, end_pos, count(*) AS num_sites, avg(value) AS mean_smooth, stddev_pop(value) AS std_smooth, median(value) AS median_smooth, coalesce(max(gap), 0) AS max_site_gap,
  end_pos - start_pos AS length_bp, count(*) * 1000 / CAST(end_pos - start_pos AS DOUBLE) AS site_density, CAST(count(value) AS DOUBLE) / count(*) AS data_completeness
  FROM (SELECT t.chrom, t.start_pos, t.end_pos, v.pos, v.value, v.pos - lag(v.pos) OVER (PARTITION BY t.chrom, t.start_pos ORDER BY v.pos) AS gap FROM ({TILES}) t JOIN ({SMOOTH}) v ON v.chrom = t.chrom AND v.pos BETWEEN t.start_pos AND t.end_pos)
  GROUP BY chrom, start_pos, end_pos"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = smooth.tricube_smooth(smooth.fractions(view(spark, sf_dir, "sites")), 100)
    return denovo.segment_metrics(track, axis.tiles(view(spark, sf_dir, "chrom_sizes"), TILE), TILE)


@query(f"WITH f AS ({FRACTION}) SELECT chrom, start_pos, end_pos, num_sites, max_site_gap, length_bp, round(mean_smooth, 6) AS mean_smooth, round(std_smooth, 6) AS std_smooth, round(median_smooth, 6) AS median_smooth, round(site_density, 6) AS site_density, round(data_completeness, 6) AS data_completeness FROM ({METRICS})")
def agg_segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    return m.select("chrom", "start_pos", "end_pos", "num_sites", "max_site_gap", "length_bp", *[r6(F.col(c), c) for c in ("mean_smooth", "std_smooth", "median_smooth", "site_density", "data_completeness")])


@query(f"WITH f AS ({FRACTION}) SELECT chrom, start_pos, num_sites, CASE WHEN mean_smooth < CAST(0.35 AS DOUBLE) THEN 'LMR' WHEN mean_smooth > CAST(0.45 AS DOUBLE) THEN 'HMR' ELSE 'PMR' END AS type FROM ({METRICS}) WHERE num_sites >= 2 AND length_bp BETWEEN 10 AND 500 AND max_site_gap <= 50 AND data_completeness >= 0.7")
def seg_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denovo.classify(metrics(spark, sf_dir), 0.35, 0.45, 10, 500, 50).select("chrom", "start_pos", "num_sites", "type")


@query("""WITH w AS (SELECT event_type AS chrom, event_id AS pos, avg(value) OVER a AS m1, var_samp(value) OVER a AS v1, count(value) OVER a AS n1, avg(value) OVER b AS m2, var_samp(value) OVER b AS v2, count(value) OVER b AS n2 FROM events
  WINDOW a AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING))
SELECT chrom, pos, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM w WHERE n1 = 50 AND n2 = 50""")
def win_adjacent_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denovo.adjacent_tests(view(spark, sf_dir, "signal"), 50).select("chrom", "pos", r6(F.col("t"), "t"))


@query()
def seg_cbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denovo.segment(view(spark, sf_dir, "signal"))


@query()
def seg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denovo.merge_segments(denovo.segment(view(spark, sf_dir, "signal")), 500, 10.0, 30.0)


# differences between groups of cells

LABELLED = f"SELECT region, m.cell_id, cell_type AS grp, mean AS x FROM ({TILED}) m JOIN {{cells}} c ON m.cell_id = c.cell_id"
MOMENTS = """SELECT *, s1 / n1 AS m1, s2 / nullif(n2, 0) AS m2, CASE WHEN n1 > 1 THEN (q1 - s1 * s1 / n1) / (n1 - 1) END AS v1, CASE WHEN n2 > 1 THEN (q2 - s2 * s2 / n2) / (n2 - 1) END AS v2 FROM (
  SELECT *, sum(n1) OVER (PARTITION BY region) - n1 AS n2, sum(s1) OVER (PARTITION BY region) - s1 AS s2, sum(q1) OVER (PARTITION BY region) - q1 AS q2 FROM (
    SELECT region, grp, count(x) AS n1, sum(x) AS s1, sum(x * x) AS q1 FROM l GROUP BY region, grp))"""
T = f"SELECT *, sqrt(greatest(v1 / n1 + v2 / n1, 0)) AS e FROM ({MOMENTS})"
RANKS = """SELECT *, n - n1 AS n2 FROM (SELECT *, sum(n1) OVER (PARTITION BY region) AS n FROM (SELECT region, grp, count(*) AS n1, sum(r) AS r1 FROM (
  SELECT region, grp, rank() OVER (PARTITION BY region ORDER BY x) + (count(*) OVER (PARTITION BY region, x) - 1) / CAST(2 AS DOUBLE) AS r FROM l) GROUP BY region, grp)) WHERE n > n1"""
Z = f"SELECT *, (r1 - n1 * (n + 1) / CAST(2 AS DOUBLE)) / sqrt(n1 * n2 * (n + 1) / CAST(12 AS DOUBLE)) AS z, (r1 - n1 * (n1 + 1) / CAST(2 AS DOUBLE)) / (n1 * n2) AS auc FROM ({RANKS})"


def rows_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.labelled(tiled(spark, sf_dir), view(spark, sf_dir, "cells"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, n1, CAST(n2 AS BIGINT) AS n2, round(m1 + 1e-9, 6) AS m1, round(m2 + 1e-9, 6) AS m2, round((m1 - m2) / CASE WHEN e > 1e-9 THEN e END, 6) AS t FROM ({T})")
def dif_ttest_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.t_test(rows_by_type(spark, sf_dir)).select("region", "grp", "n1", "n2", *[r6(F.col(c) + 1e-9, c) for c in ("m1", "m2")], r6(F.col("t"), "t"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, CASE WHEN m2 > 0 THEN round(m1 / m2, 6) END AS fc, round(log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)), 5) AS lfc FROM ({T})")
def dif_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.fold_change(rows_by_type(spark, sf_dir)).select("region", "grp", r6(F.col("fc"), "fc"), F.round("lfc", 5).alias("lfc"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, n1, CAST(n2 AS BIGINT) AS n2, round(z, 6) AS z FROM ({Z})")
def dif_wilcoxon_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.wilcoxon(rows_by_type(spark, sf_dir)).select("region", "grp", "n1", "n2", r6(F.col("z"), "z"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, round(auc + 1e-9, 6) AS auc, round(abs(auc - 0.5) + 0.5 + 1e-9, 6) AS auroc FROM ({Z})")
def dif_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = diff.wilcoxon(rows_by_type(spark, sf_dir))
    return a.select("region", "grp", r6(F.col("auc") + 1e-9, "auc"), r6(F.abs(F.col("auc") - 0.5) + 0.5 + 1e-9, "auroc"))


COSG = """SELECT region, grp, c, CASE WHEN sum(c * c) OVER (PARTITION BY region) > 0 THEN pow(c, 3) / sum(c * c) OVER (PARTITION BY region) ELSE 0 END AS score FROM (
  SELECT region, o.grp, CASE WHEN sum(q) OVER (PARTITION BY region) > 0 THEN s / sqrt(sum(q) OVER (PARTITION BY region) * size) ELSE 0 END AS c FROM (SELECT region, grp, sum(x) AS s, sum(x * x) AS q FROM l GROUP BY region, grp) o
  JOIN (SELECT grp, count(DISTINCT cell_id) AS size FROM l GROUP BY grp) z ON o.grp = z.grp)"""


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, round(c, 6) AS c, round(score, 6) AS score FROM ({COSG})")
def dif_cosg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.cosg(rows_by_type(spark, sf_dir)).select("region", "grp", r6(F.col("c"), "c"), r6(F.col("score"), "score"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, region) AS rank FROM ({COSG})) WHERE rank <= 5")
def top_group_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = diff.cosg(rows_by_type(spark, sf_dir)).withColumn("key", F.round("score", 9))
    return diff.top_per_group(scored, 5, "key").select("region", "grp", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


P = "least(1.0, ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"
PVALUES = f"SELECT region, grp, z, round({P}, 9) AS p FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM (SELECT *, abs(z) / sqrt(CAST(2 AS DOUBLE)) AS x FROM (SELECT region, grp, round(z, 9) AS z FROM ({Z}))))"
ADJUSTED = f"""SELECT region, grp, z, p, least(1.0, min(p * m / k) OVER (PARTITION BY grp ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM (
  SELECT *, count(*) OVER (PARTITION BY grp) AS m, count(*) OVER (PARTITION BY grp ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM ({PVALUES}))"""


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = diff.wilcoxon(rows_by_type(spark, sf_dir)).withColumn("z", F.round("z", 9))
    return diff.bh_adjust(w.withColumn("p", F.round(diff.normal_p(F.col("z")), 9)), "p", "grp")


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, round(p, 6) AS p, round(padj, 6) AS padj FROM ({ADJUSTED})")
def dif_bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted(spark, sf_dir).select("region", "grp", r6(F.col("p"), "p"), r6(F.col("padj"), "padj"))


@query(f"""WITH l AS ({LABELLED}) SELECT a.region, a.grp, CASE WHEN p < 0.05 AND round(m1 - m2, 9) > 0.02 THEN 'hyper' WHEN p < 0.05 AND round(m1 - m2, 9) < -0.02 THEN 'hypo' ELSE 'nonsignificant' END AS class FROM ({ADJUSTED}) a JOIN ({T}) t ON a.region = t.region AND a.grp = t.grp""")
def plt_volcano_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sites import volcano_class

    moments = diff.t_test(rows_by_type(spark, sf_dir)).select("region", "grp", F.round(F.col("m1") - F.col("m2"), 9).alias("d"))
    return adjusted(spark, sf_dir).join(moments, ["region", "grp"]).select("region", "grp", volcano_class(F.col("d"), F.col("p"), 0.05, 0.02).alias("class"))


# annotation and enrichment

PROMOTERS = """SELECT gene_id, chrom, strand, feature, greatest(CASE WHEN strand <> '-' THEN anchor_p + a ELSE anchor_m - b END, 1) AS start_pos, greatest(CASE WHEN strand <> '-' THEN anchor_p + b ELSE anchor_m - a END, 0) AS end_pos FROM (
  SELECT gene_id, chrom, strand, feature, a, b, CASE WHEN feature = 'downstream' THEN end_pos ELSE start_pos END AS anchor_p, CASE WHEN feature = 'downstream' THEN start_pos ELSE end_pos END AS anchor_m
  FROM {genes}, (VALUES ('promoter(<=1kb)', -10, -1), ('promoter(1-5kb)', -50, -11), ('downstream', 1, 10)) AS v(feature, a, b))"""
PROMOTERS = f"SELECT * FROM ({PROMOTERS}) WHERE start_pos <= end_pos"


def promoter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.promoters(view(spark, sf_dir, "genes"), 10, 50, 10)


@query(PROMOTERS)
def ann_promoters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promoter_rows(spark, sf_dir)


RESOLVED = f"""SELECT region, coalesce(feature, 'Distal intergenic') AS feature, coalesce(genes, '') AS genes FROM (SELECT r.region, x.feature, string_agg(DISTINCT x.gene_id, ',' ORDER BY x.gene_id) AS genes,
  row_number() OVER (PARTITION BY r.region ORDER BY CASE x.feature WHEN 'promoter(1-5kb)' THEN 1 WHEN 'promoter(<=1kb)' THEN 2 WHEN 'downstream' THEN 7 WHEN 'gene' THEN 8 END) AS k
  FROM {{regions}} r LEFT JOIN (SELECT gene_id, chrom, feature, start_pos, end_pos FROM ({PROMOTERS}) UNION ALL SELECT gene_id, chrom, 'gene', start_pos, end_pos FROM {{genes}}) x
  ON r.chrom = x.chrom AND r.start_pos <= x.end_pos AND x.start_pos <= r.end_pos GROUP BY r.region, x.feature) WHERE k = 1"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = view(spark, sf_dir, "genes")
    features = promoter_rows(spark, sf_dir).drop("strand").unionByName(genes.select("gene_id", "chrom", F.lit("gene").alias("feature"), "start_pos", "end_pos"))
    return annotate.resolve(view(spark, sf_dir, "regions"), features, bin_width=100)


@query(RESOLVED)
def ann_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)


@query(f"SELECT lower(split_part(feature, ' ', 1)) AS feature, count(*) AS n FROM ({RESOLVED}) GROUP BY lower(split_part(feature, ' ', 1))")
def ann_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).groupBy(F.lower(F.split("feature", " ")[0]).alias("feature")).agg(F.count(F.lit(1)).alias("n"))


LISTED = "SELECT DISTINCT gene_id FROM {genes} WHERE gene_type = 'protein_coding'"
SETS = f"""SELECT term, count(*) AS k, count(l.gene_id) AS x, (SELECT count(*) FROM ({LISTED}) WHERE gene_id IN (SELECT gene_id FROM {{gene_sets}})) AS n, (SELECT count(DISTINCT gene_id) FROM {{gene_sets}}) AS m
  FROM (SELECT DISTINCT term, gene_id FROM {{gene_sets}}) s LEFT JOIN ({LISTED}) l ON s.gene_id = l.gene_id GROUP BY term"""


def tail(x: str, m: str, k: str, n: str) -> str:
    lc = lambda a, b: f"lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - ({b}) + 1)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(greatest({x}, {n} + {k} - {m}), least({k}, {n}) + 1), lambda i: exp({lc(k, 'i')} + {lc(f'({m} - {k})', f'({n} - i)')} - ({lc(m, n)}))))) END"


def protein_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genes").filter("gene_type = 'protein_coding'").select("gene_id")


@query(SETS)
def enr_geneset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.set_counts(protein_coding(spark, sf_dir), view(spark, sf_dir, "gene_sets"))


@query(f"SELECT term, x, round({tail('x', 'm', 'k', 'n')}, 6) AS pval, round((x + 0.5) * (m - k - n + x + 0.5) / ((k - x + 0.5) * (n - x + 0.5)), 6) AS odds_ratio FROM (SELECT term, CAST(k AS DOUBLE) AS kd, k, x, n, m FROM ({SETS})) WHERE x > 0")
def enr_geneset_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enrich.enrich(protein_coding(spark, sf_dir), view(spark, sf_dir, "gene_sets"))
    return e.select("term", "x", r6(F.col("pval"), "pval"), r6(F.col("odds_ratio"), "odds_ratio"))


@query(f"""SELECT motif_id, "both", only_chosen, only_motif, neither, round({tail('"both"', 't', 'w', 'c')}, 6) AS pval FROM (SELECT *, c - "both" AS only_chosen, w - "both" AS only_motif, t - c - w + "both" AS neither FROM (
  SELECT motif_id, count(*) FILTER (WHERE kind = 'ECONOMY') AS "both", count(*) AS w, (SELECT count(*) FROM {{regions}}) AS t, (SELECT count(*) FROM {{regions}} WHERE kind = 'ECONOMY') AS c FROM {{motif_hits}} h JOIN {{regions}} r ON h.region = r.region GROUP BY motif_id))""")
def enr_motif_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = view(spark, sf_dir, "regions")
    e = enrich.motif_enrichment(regions, regions.filter("kind = 'ECONOMY'"), view(spark, sf_dir, "motif_hits"))
    return e.select("motif_id", "both", "only_chosen", "only_motif", "neither", r6(F.col("pval"), "pval"))


# sets and samples


@query(f"SELECT 'tiles' AS modality, cell_id, region, mean FROM ({TILED}) UNION ALL SELECT 'regions', cell_id, region, mean FROM (WITH f AS ({FRACTION}) SELECT s.cell_id, r.region, round_even(CAST(count(*) FILTER (WHERE state = 1) AS DOUBLE) / count(*), 3) AS mean FROM {{sites}} s JOIN {{regions}} r ON s.chrom = r.chrom AND s.pos BETWEEN r.start_pos - 1 AND r.end_pos - 1 AND r.start_pos < r.end_pos WHERE state <> 0 GROUP BY s.cell_id, r.region)")
def set_union_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"tiles": tiled(spark, sf_dir), "regions": matrix.region_matrix(view(spark, sf_dir, "sites"), view(spark, sf_dir, "regions"), bin_width=100)}
    one, two = (df.select(F.lit(n).alias("modality"), "cell_id", "region", "mean") for n, df in parts.items())
    return one.unionByName(two)


@query("SELECT region FROM {regions} INTERSECT SELECT region FROM {motif_hits}")
def set_intersect_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "regions").select("region").intersect(view(spark, sf_dir, "motif_hits").select("region"))


@query("SELECT cell_id FROM {cells} EXCEPT SELECT cell_id FROM {cells} WHERE score < 1000")
def set_except_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cells")
    return cells.select("cell_id").subtract(cells.filter("score < 1000").select("cell_id"))


@query("""WITH s AS (SELECT DISTINCT motif_id, region FROM {motif_hits}), n AS (SELECT motif_id, count(*) AS n FROM s GROUP BY motif_id)
SELECT a.motif_id AS a, b.motif_id AS b, round(count(*) / CAST(na.n + nb.n - count(*) AS DOUBLE), 6) AS jaccard FROM s a JOIN s b ON a.region = b.region AND a.motif_id < b.motif_id JOIN n na ON na.motif_id = a.motif_id JOIN n nb ON nb.motif_id = b.motif_id GROUP BY a.motif_id, b.motif_id, na.n, nb.n""")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "motif_hits").select("motif_id", "region").distinct()
    n = s.groupBy("motif_id").agg(F.count(F.lit(1)).alias("n"))
    shared = s.withColumnRenamed("motif_id", "a").join(s.withColumnRenamed("motif_id", "b"), "region").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    both = shared.join(F.broadcast(n.toDF("a", "na")), "a").join(F.broadcast(n.toDF("b", "nb")), "b")
    return both.select("a", "b", r6(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), "jaccard"))


@query("SELECT cell_id, cell_type FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY (CAST(cell_id AS BIGINT) * 2654435761 + 12345) % 4294967296, cell_id) AS k FROM {cells}) WHERE k <= 5")
def smp_stratified_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    h = (F.col("cell_id").cast("long") * 2654435761 + 12345) % 4294967296
    ranked = view(spark, sf_dir, "cells").withColumn("k", F.row_number().over(Window.partitionBy("cell_type").orderBy(h, "cell_id")))
    return ranked.filter("k <= 5").select("cell_id", "cell_type")


# distances and clusters

PAIRED = """SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, count(*) AS n, sum(CAST(a.state AS DOUBLE)) AS sx, sum(CAST(b.state AS DOUBLE)) AS sy, sum(CAST(a.state * a.state AS DOUBLE)) AS xx, sum(CAST(b.state * b.state AS DOUBLE)) AS yy,
  sum(CAST(a.state * b.state AS DOUBLE)) AS xy, count(*) FILTER (WHERE a.state = b.state) AS same FROM {sites} a JOIN {sites} b ON a.chrom = b.chrom AND a.pos = b.pos AND a.cell_id < b.cell_id GROUP BY a.cell_id, b.cell_id"""


@query(f"SELECT cell_a, cell_b, n, CASE WHEN (n * xx - sx * sx) * (n * yy - sy * sy) > 0 THEN round((n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)), 6) END AS pearson FROM ({PAIRED})")
def dst_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.cell_similarity(view(spark, sf_dir, "sites")).select("cell_a", "cell_b", "n", r6(F.col("pearson"), "pearson"))


@query(f"SELECT cell_a, cell_b, CASE WHEN xx * yy > 0 THEN round(xy / sqrt(xx * yy), 6) END AS cosine FROM ({PAIRED})")
def dst_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.cell_similarity(view(spark, sf_dir, "sites")).select("cell_a", "cell_b", r6(F.col("cosine"), "cosine"))


@query(f"SELECT cell_a, cell_b, round(CAST(same AS DOUBLE) / n, 6) AS match_fraction FROM ({PAIRED})")
def dst_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.cell_similarity(view(spark, sf_dir, "sites")).select("cell_a", "cell_b", r6(F.col("match_fraction"), "match_fraction"))


E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def pair_sql(expr: str, e: str = E) -> str:
    return f"WITH {e} SELECT a.vec_id AS i, b.vec_id AS j, round({expr}, 6) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id"


def pairs(spark: SparkSession, sf_dir: str, metric: str, vec=None) -> DataFrame:
    rows = view(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    if vec is not None:
        rows = rows.withColumn("v", vec)
    return embed.pairwise(rows, "vec_id", "v", metric).withColumn("d", F.round("d", 6))


@query(pair_sql("list_distance(a.v, b.v)"))
def dst_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "euclidean")


@query(pair_sql("list_sum(list_transform(range(1, len(a.v) + 1), lambda k: abs(a.v[k] - b.v[k])))"))
def dst_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "manhattan")


@query(pair_sql("greatest(0, -ln(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: sqrt(a.v[k] * b.v[k])))))", "s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM s)"))
def dst_bhattacharyya(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "bhattacharyya", F.transform("v", F.abs))


@query("""WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
r AS (SELECT vec_id, k, rank() OVER (PARTITION BY vec_id ORDER BY v) + (count(*) OVER (PARTITION BY vec_id, v) - 1) / CAST(2 AS DOUBLE) AS r FROM x)
SELECT a.vec_id AS i, b.vec_id AS j, round(0.5 - corr(a.r, b.r) / 2, 6) AS d FROM r a JOIN r b ON a.k = b.k AND a.vec_id < b.vec_id GROUP BY a.vec_id, b.vec_id""")
def dst_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, "spearman")


NEAR = f"{E}, near AS (SELECT i, j, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, round(1 - list_cosine_similarity(a.v, b.v), 9) + 0.0 AS d FROM e a CROSS JOIN e b)) WHERE rank <= 10)"


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.neighbours(view(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


@query(f"WITH {NEAR} SELECT i, j, rank, abs(round(d, 6)) AS d FROM near")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir).select("i", "j", F.col("rank").cast("long").alias("rank"), F.abs(F.round("d", 6)).alias("d"))


@query(f"""WITH {NEAR}, p AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM near WHERE i <> j),
c AS (SELECT p.src, p.dst, count(*) AS k FROM p JOIN near a ON a.i = p.src JOIN near b ON b.i = p.dst AND b.j = a.j GROUP BY p.src, p.dst)
SELECT src, dst, round(k / CAST(20 - k AS DOUBLE), 6) AS weight FROM c""")
def clu_knn_jaccard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.jaccard_edges(near(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query()
def clu_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    save = saver(spark, "louvain")
    edges = save(embed.jaccard_edges(near(spark, sf_dir)), "edges")
    return cluster.communities(edges, save)


@query()
def clu_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(view(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def clu_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dendrogram of the cell types' mean profiles: a row a merge."""
    means = rows_by_type(spark, sf_dir).groupBy("grp", "region").agg(F.avg("x").alias("x"))
    wide = means.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("region", "x"))).alias("v")).orderBy("grp")
    rows = wide.select("grp", F.map_from_entries("v").alias("v")).collect()  # a row a cell type
    names = sorted({k for r in rows for k in r["v"]})
    x = np.array([[r["v"].get(k, 0.0) for k in names] for r in rows])
    merges = cluster.linkage(embed.distances(x, x, "euclidean"), "average")
    return spark.createDataFrame([(i, a, b, h, s) for i, (a, b, h, s) in enumerate(merges)], "step long, left long, right long, height double, size long")


@query()
def red_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ratio = embed.pca(view(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    total = np.cumsum(ratio)
    return spark.createDataFrame([(i + 1, float(r), float(t)) for i, (r, t) in enumerate(zip(ratio, total, strict=True))], "pc long, ratio double, cumulative double")


@query()
def red_pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = embed.pca(view(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return scores


@query()
def red_sparse_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of three sparse logistic components of the cells' most variable tiles."""
    m = tiled(spark, sf_dir)
    top = matrix.top_variable(matrix.region_stats(m), 200, "var").select("region")  # a block of bounded width
    binary = m.join(F.broadcast(top), "region").select("cell_id", "region", (F.col("mean") > 0.5).cast("double").alias("x")).toPandas()
    wide = binary.pivot(index="cell_id", columns="region", values="x").sort_index(axis=0).sort_index(axis=1)
    _, _, b = logistic_pca.fit(wide.to_numpy(), 3, 0.5)
    rows = [(r, k + 1, float(b[i, k])) for i, r in enumerate(wide.columns) for k in range(b.shape[1])]
    return spark.createDataFrame(rows, "region string, component long, loading double")


@query("""WITH t AS (SELECT label_true AS a, label_pred AS b, CAST(count(*) AS DOUBLE) AS n FROM {cluster_labels} GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS bo, sum(n) AS total FROM t),
l AS (SELECT sum(m * (m - 1) / 2) AS le FROM (SELECT sum(n) AS m FROM t GROUP BY a)), r AS (SELECT sum(m * (m - 1) / 2) AS ri FROM (SELECT sum(n) AS m FROM t GROUP BY b))
SELECT round((bo - le * ri / (total * (total - 1) / 2)) / ((le + ri) / 2 - le * ri / (total * (total - 1) / 2)), 6) AS ari FROM s, l, r""")
def clu_agreement_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.rand_index(view(spark, sf_dir, "cluster_labels"), "label_true", "label_pred").withColumn("ari", F.round("ari", 6))


@query("""WITH t AS (SELECT label_true AS a, label_pred AS b, CAST(count(*) AS DOUBLE) AS n FROM {cluster_labels} GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM t),
m AS (SELECT sum(n / t * ln(t * n / (ra * cb))) AS mi FROM u), x AS (SELECT -sum(ra / t * ln(ra / t)) AS ha FROM (SELECT DISTINCT a, ra, t FROM u)), y AS (SELECT -sum(cb / t * ln(cb / t)) AS hb FROM (SELECT DISTINCT b, cb, t FROM u))
SELECT round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM m, x, y""")
def clu_agreement_vmeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cluster.v_measure(view(spark, sf_dir, "cluster_labels"), "label_true", "label_pred")
    return v.select(*[r6(F.col(c), c) for c in ("homogeneity", "completeness", "v_measure")])


@query("""WITH p AS (SELECT label_true, count(*) / CAST((SELECT count(*) FROM {cluster_labels}) AS DOUBLE) AS p FROM {cluster_labels} GROUP BY 1), q AS (SELECT label_pred, count(*) / CAST((SELECT count(*) FROM {cluster_labels}) AS DOUBLE) AS q FROM {cluster_labels} GROUP BY 1)
SELECT round(avg(abs(p - q)), 6) AS mae, round(avg((p - q) * (p - q)), 6) AS mse FROM {cluster_labels} l JOIN p ON p.label_true = l.label_true JOIN q ON q.label_pred = l.label_pred""")
def agg_prevalence_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cluster.prevalence_error(view(spark, sf_dir, "cluster_labels"), "label_true", "label_pred")
    return e.select(r6(F.col("mae"), "mae"), r6(F.col("mse"), "mse"))


# plot tables


@query("SELECT t.cell_type, s.sample, count(c.cell_id) AS n FROM (SELECT DISTINCT cell_type FROM {cells}) t CROSS JOIN (SELECT DISTINCT sample FROM {cells}) s LEFT JOIN {cells} c ON c.cell_type = t.cell_type AND c.sample = s.sample GROUP BY t.cell_type, s.sample")
def plt_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.composition(view(spark, sf_dir, "cells"), "cell_type", "sample")


@query("SELECT cell_type, sample, n, round(n / CAST(sum(n) OVER (PARTITION BY cell_type) AS DOUBLE), 6) AS proportion FROM (SELECT cell_type, sample, count(*) AS n FROM {cells} GROUP BY 1, 2)")
def plt_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.proportions(view(spark, sf_dir, "cells"), "cell_type", "sample").withColumn("proportion", F.round("proportion", 6))


@query(f"WITH l AS ({LABELLED}) SELECT grp, count(x) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3 FROM l GROUP BY grp")
def plt_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.group_quartiles(rows_by_type(spark, sf_dir), "grp", "x")
    return q.select("grp", "n", *[r6(F.col(f"q{k}"), f"q{k}") for k in (1, 2, 3)])


@query(f"WITH {M} SELECT CAST(floor(covered / CAST(10 AS DOUBLE)) * 10 AS BIGINT) AS bin, count(*) AS n FROM (SELECT region, count(mean) AS covered FROM m GROUP BY region) GROUP BY 1")
def plt_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matrix.region_stats(tiled(spark, sf_dir))
    return views.histogram(s, "covered_cell", 10).withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {M} SELECT cell_id, n_features, round(100 * (1 - row_number() OVER (ORDER BY n_features, cell_id) / CAST(count(*) OVER () AS DOUBLE)), 6) AS pass_pct FROM (SELECT cell_id, count(mean) AS n_features FROM m GROUP BY cell_id)")
def plt_pass_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tiled(spark, sf_dir).groupBy("cell_id").agg(F.count("mean").alias("n_features"))
    return views.pass_curve(n, saver(spark, "pass_curve"), "n_features", "cell_id").withColumn("pass_pct", F.round("pass_pct", 6))


@query("SELECT label, round(median(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(median(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY label")
def plt_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = view(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in ((0, "x"), (1, "y"))])
    return views.centroids(xy, "label", "x", "y").select("label", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query()
def plt_row_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pack_rows(view(spark, sf_dir, "genes"), 50)

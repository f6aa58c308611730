"""Queries on sites, regions and the matrix, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sites as S
from ..operators import axis, matrix, smooth
from .fixtures import view, with_views
from .tables import saver

TILE, BANDWIDTH, NEIGHBOURS, CAP = 100, 100, 10, 50
QUERIES, ORACLE = {}, {}


def query(sql: str):
    """Register a function and its oracle under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def half_up(c, name: str):
    """Six places, by arithmetic that is the same everywhere."""
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name)


def sql_moments(c: str, units: int) -> tuple[str, str]:
    """SQL of mean and population variance of values counted in ``units`` of one, six places each."""
    k = f"CAST(floor({c} * CAST({units} AS DOUBLE) + 0.5) AS HUGEINT)"
    n = f"CAST(count({c}) AS DOUBLE)"
    six = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
    mean = f"CAST(sum({k}) AS DOUBLE) / ({n} * CAST({units} AS DOUBLE))"
    var = f"CAST(count({c}) * sum({k} * {k}) - sum({k}) * sum({k}) AS DOUBLE) / ({n} * {n} * CAST({units} AS DOUBLE) * CAST({units} AS DOUBLE))"
    return six(mean), six(var)


MEAN6, VAR6 = sql_moments("mean", 1000)
SR_VAR6 = sql_moments("relative", 10**9)[1]


@query("SELECT cell_id, chrom, pos, meth, cov, context, strand FROM {sites_raw} WHERE upper(context) LIKE 'CG%' OR upper(context) = 'CPG'")
def src_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites_raw").filter(S.is_cg(F.col("context")))


@query("""SELECT cell_id, chrom, pos, round(CAST(meth AS DOUBLE) / cov, 6) AS ratio,
  CASE WHEN CAST(meth AS DOUBLE) / cov >= CAST(0.9 AS DOUBLE) THEN 1 WHEN CAST(meth AS DOUBLE) / cov <= CAST(0.1 AS DOUBLE) THEN -1 ELSE 0 END AS state,
  CAST(CASE WHEN CAST(meth AS DOUBLE) / cov >= CAST(0.9 AS DOUBLE) THEN 1 WHEN CAST(meth AS DOUBLE) / cov <= CAST(0.1 AS DOUBLE) THEN -1 END AS STRING) AS strict_state,
  CASE WHEN CAST(meth AS DOUBLE) / cov > CAST(0.9 AS DOUBLE) THEN 1 WHEN CAST(meth AS DOUBLE) / cov <= CAST(0.1 AS DOUBLE) THEN 0 ELSE -1 END AS binary_state FROM {sites_raw}""")
def sca_trinarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = S.ratio(F.col("meth"), F.col("cov"))
    return view(spark, sf_dir, "sites_raw").select("cell_id", "chrom", "pos", r6(share, "ratio"), S.trinarise(share).alias("state"), S.trinarise(share, ambiguous=None).cast("string").alias("strict_state"), S.binarise(share).alias("binary_state"))


@query("SELECT cell_id, chrom, pos, cov AS total_given, cov + meth AS unmeth_given, cov + meth AS total_inverted, cov AS unmeth_inverted FROM {sites_raw}")
def sca_coverage_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, o = F.col("meth"), F.col("cov")
    modes = {"total_given": (True, False), "unmeth_given": (False, False), "total_inverted": (True, True), "unmeth_inverted": (False, True)}
    return view(spark, sf_dir, "sites_raw").select("cell_id", "chrom", "pos", *[S.coverage(m, o, *k).alias(n) for n, k in modes.items()])


@query("""SELECT chrom, count(*) AS n, chrom AS added, substr(chrom, 4) AS removed, regexp_replace(upper(chrom), '^CHR', '') AS bare FROM {sites_raw} GROUP BY chrom""")
def sca_chrom_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("chrom")
    per = view(spark, sf_dir, "sites_raw").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    bare = S.chrom_name(c, "remove_chr")
    return per.select("chrom", "n", S.chrom_name(bare, "add_chr").alias("added"), bare.alias("removed"), S.chrom_name(c, "bare_upper").alias("bare"))


@query("SELECT region, concat(chrom, ':', CAST(start_pos AS STRING), '-', CAST(end_pos AS STRING)) AS name, chrom, start_pos, end_pos FROM {regions}")
def sca_region_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = view(spark, sf_dir, "regions").select("region", S.region_name(F.col("chrom"), F.col("start_pos"), F.col("end_pos")).alias("name"))
    chrom, start, end = S.parse_region(F.col("name"))
    return named.select("region", "name", chrom.alias("chrom"), start.alias("start_pos"), end.alias("end_pos"))


FRACTION = "SELECT chrom, pos, count(*) AS n_obs, count(*) FILTER (WHERE state > 0) AS n_meth, CAST(count(*) FILTER (WHERE state > 0) AS DOUBLE) / count(*) AS mfrac FROM {sites} GROUP BY chrom, pos"


@query(f"SELECT chrom, pos, n_obs, n_meth, round(mfrac, 6) AS mfrac FROM ({FRACTION})")
def agg_site_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.fractions(view(spark, sf_dir, "sites")).select("chrom", "pos", "n_obs", "n_meth", r6(F.col("mfrac"), "mfrac"))


@query(f"""SELECT chrom, pos, round(CASE WHEN mfrac > 0 THEN -mfrac * log2(mfrac) ELSE 0 END + CASE WHEN mfrac < 1 THEN -(1 - mfrac) * log2(1 - mfrac) ELSE 0 END, 6) AS entropy FROM ({FRACTION})""")
def sca_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.fractions(view(spark, sf_dir, "sites")).select("chrom", "pos", r6(S.entropy(F.col("mfrac")), "entropy"))


@query("""SELECT cell_id, count(*) AS sites, count(*) FILTER (WHERE state = 1) AS meth, CAST(sum(cov) AS BIGINT) AS n_total,
  round(CAST(count(*) FILTER (WHERE state = 1) AS DOUBLE) / count(*), 6) AS global_meth_level FROM {sites} GROUP BY cell_id""")
def agg_cell_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.cell_qc(view(spark, sf_dir, "sites")).withColumn("global_meth_level", F.round("global_meth_level", 6))


@query("""SELECT cell_id, count(*) AS n_total, count(*) FILTER (WHERE context NOT LIKE 'CG%') AS non_cg, count(*) FILTER (WHERE context LIKE 'CG%') AS cg,
  count(*) FILTER (WHERE context LIKE 'CG%' AND CAST(meth AS DOUBLE) / cov >= CAST(0.9 AS DOUBLE)) AS meth,
  count(*) FILTER (WHERE context LIKE 'CG%' AND CAST(meth AS DOUBLE) / cov <= CAST(0.1 AS DOUBLE)) AS unmeth FROM {sites_raw} GROUP BY cell_id""")
def agg_cell_qc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = S.trinarise(S.ratio(F.col("meth"), F.col("cov")))
    cg = S.is_cg(F.col("context"))
    return view(spark, sf_dir, "sites_raw").groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~cg).alias("non_cg"), F.count_if(cg).alias("cg"), F.count_if(cg & (state == 1)).alias("meth"), F.count_if(cg & (state == -1)).alias("unmeth")
    )


@query("SELECT chrom, length FROM {chrom_sizes}")
def agg_chrom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites_raw").groupBy("chrom").agg((F.max("pos") + 1).alias("length"))


CLASSES = ("CG", "CGA", "CHH")
_PIVOT = ", ".join(
    f"CAST(sum(meth) FILTER (WHERE context = '{c}') AS BIGINT) AS meth_{c}, count(*) FILTER (WHERE context = '{c}') AS n_{c}, CAST(sum(cov) FILTER (WHERE context = '{c}') AS BIGINT) AS total_{c}, "
    f"round(CAST(sum(meth) FILTER (WHERE context = '{c}') AS DOUBLE) / sum(cov) FILTER (WHERE context = '{c}'), 6) AS level_{c}"
    for c in CLASSES
)


@query(f"SELECT cell_id, {_PIVOT} FROM {{sites_raw}} GROUP BY cell_id")
def agg_class_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.sum("meth").alias("meth"), F.count(F.lit(1)).alias("n"), F.sum("cov").alias("total"), F.round(F.sum("meth") / F.sum("cov"), 6).alias("level")]
    wide = view(spark, sf_dir, "sites_raw").groupBy("cell_id").pivot("context", list(CLASSES)).agg(*aggs)
    cols = [F.coalesce(f"{c}_n", F.lit(0)).alias(f"n_{c}") if k == "n" else F.col(f"{c}_{k}").alias(f"{k}_{c}") for c in CLASSES for k in ("meth", "n", "total", "level")]
    return wide.select("cell_id", *cols)


@query(f"SELECT chrom, CAST(s AS BIGINT) AS start_pos, least(s + {TILE - 1}, length) AS end_pos FROM (SELECT chrom, length, unnest(range(1, length + 1, {TILE // 2})) AS s FROM {{chrom_sizes}})")
def win_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.tiles(view(spark, sf_dir, "chrom_sizes"), TILE, TILE // 2)


MEAN = "round_even(CAST(count(*) FILTER (WHERE state = 1) AS DOUBLE) / count(*) FILTER (WHERE state <> 0), 3)"
TILED = f"""SELECT cell_id, concat(chrom, ':', CAST(t * {TILE} + 1 AS STRING), '-', CAST((t + 1) * {TILE} AS STRING)) AS region, {MEAN} AS mean, count(*) AS n_obs
  FROM (SELECT *, pos // {TILE} AS t FROM {{sites}} WHERE state <> 0) GROUP BY cell_id, chrom, t"""


@query(TILED)
def agg_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.tile_mean(view(spark, sf_dir, "sites"), TILE)


H = BANDWIDTH // 2
SMOOTH = f"""SELECT a.chrom, a.pos, sum(b.mfrac * pow(1 - pow(abs(b.pos - a.pos) / CAST({H} AS DOUBLE), 3), 3) * ln(1 + b.n_obs)) /
  sum(pow(1 - pow(abs(b.pos - a.pos) / CAST({H} AS DOUBLE), 3), 3) * ln(1 + b.n_obs)) AS value
  FROM f a JOIN f b ON a.chrom = b.chrom AND b.pos >= a.pos - {H} AND b.pos < a.pos + {H} GROUP BY a.chrom, a.pos"""


@query(f"WITH f AS ({FRACTION}) SELECT chrom, pos, round(value, 6) AS value FROM ({SMOOTH})")
def win_smooth_tricube(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = smooth.fractions(view(spark, sf_dir, "sites"))
    return smooth.tricube_smooth(track, BANDWIDTH).select("chrom", "pos", r6(F.col("value"), "value"))


@query(f"""WITH g AS ({FRACTION}), f AS (SELECT chrom, pos, n_obs, CASE WHEN mfrac > 0 THEN -mfrac * log2(mfrac) ELSE 0 END + CASE WHEN mfrac < 1 THEN -(1 - mfrac) * log2(1 - mfrac) ELSE 0 END AS mfrac FROM g)
SELECT chrom, pos, round(value, 6) AS value FROM ({SMOOTH})""")
def win_smooth_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = smooth.fractions(view(spark, sf_dir, "sites"))
    return smooth.entropy_smooth(track, BANDWIDTH).select("chrom", "pos", r6(F.col("value"), "value"))


@query(f"""WITH f AS ({FRACTION}),
d AS (SELECT a.chrom, a.pos, abs(b.pos - a.pos) AS d, row_number() OVER (PARTITION BY a.chrom, a.pos ORDER BY abs(b.pos - a.pos), b.pos) AS k FROM f a JOIN f b ON a.chrom = b.chrom AND abs(b.pos - a.pos) <= {CAP}),
w AS (SELECT f.chrom, f.pos, coalesce(d.d, {CAP}) AS b FROM f LEFT JOIN d ON f.chrom = d.chrom AND f.pos = d.pos AND k = {NEIGHBOURS})
SELECT w.chrom, w.pos, CAST(w.b AS BIGINT) AS bandwidth, round(sum(f.mfrac * exp(-pow((f.pos - w.pos) / CAST(w.b AS DOUBLE), 2)) * ln(1 + f.n_obs)) / sum(exp(-pow((f.pos - w.pos) / CAST(w.b AS DOUBLE), 2)) * ln(1 + f.n_obs)), 6) AS value
FROM w JOIN f ON w.chrom = f.chrom AND f.pos >= w.pos - w.b AND f.pos < w.pos + w.b GROUP BY w.chrom, w.pos, w.b""")
def win_smooth_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = smooth.fractions(view(spark, sf_dir, "sites"))
    return smooth.adaptive_smooth(track, NEIGHBOURS, CAP).select("chrom", "pos", "bandwidth", r6(F.col("value"), "value"))


RESIDUAL = f"""SELECT s.cell_id, r.region, {MEAN} AS mean, count(*) AS n_obs,
  (count(*) FILTER (WHERE state > 0) - sum(coalesce(v.value, 0))) / (count(*) + 1) AS relative
  FROM {{sites}} s JOIN {{regions}} r ON s.chrom = r.chrom AND s.pos BETWEEN r.start_pos - 1 AND r.end_pos - 1 AND r.start_pos < r.end_pos
  LEFT JOIN ({SMOOTH}) v ON v.chrom = s.chrom AND v.pos = s.pos WHERE state <> 0 GROUP BY s.cell_id, r.region"""


def residual_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "sites")
    track = smooth.tricube_smooth(smooth.fractions(sites), BANDWIDTH)
    return matrix.region_matrix(sites, view(spark, sf_dir, "regions"), track, bin_width=100)


@query(f"WITH f AS ({FRACTION}) SELECT cell_id, region, mean, n_obs, round(relative, 6) AS relative FROM ({RESIDUAL})")
def agg_region_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_matrix(spark, sf_dir).withColumn("relative", F.round("relative", 6))


@query(f"""WITH f AS ({FRACTION}) SELECT region, count(mean) AS covered_cell, {MEAN6} AS mean, CASE WHEN count(mean) > 1 THEN {VAR6} END AS var,
  CASE WHEN count(relative) > 1 THEN {SR_VAR6} END AS sr_var FROM ({RESIDUAL}) GROUP BY region""")
def agg_region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matrix.region_stats(residual_matrix(spark, sf_dir))
    return s.select("region", "covered_cell", *[half_up(F.col(c), c) for c in ("mean", "var", "sr_var")])


@query(f"WITH m AS ({TILED}) SELECT region, count(mean) AS covered_cell, {MEAN6} AS mean, {VAR6} AS var, round(count(mean) / CAST((SELECT count(*) FROM {{cells}}) AS DOUBLE), 6) AS pct_cell FROM m GROUP BY region")
def agg_updata_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix.tile_mean(view(spark, sf_dir, "sites"), TILE)
    n = view(spark, sf_dir, "cells").count()
    s = matrix.region_stats(m, guard=False)
    return s.select("region", "covered_cell", half_up(F.col("mean"), "mean"), half_up(F.col("var"), "var"), r6(F.col("covered_cell") / float(n), "pct_cell"))


@query("SELECT s.cell_id, s.chrom, s.pos, s.state, r.region FROM {sites} s JOIN {regions} r ON s.chrom = r.chrom AND s.pos BETWEEN r.start_pos - 1 AND r.end_pos - 1")
def jon_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = axis.range_join(view(spark, sf_dir, "sites"), view(spark, sf_dir, "regions"), 100)
    return joined.select("cell_id", "chrom", "pos", "state", "region")


@query("""SELECT region, gene_id, distance FROM (SELECT r.region, g.gene_id, CASE WHEN g.start_pos <= r.end_pos AND r.start_pos <= g.end_pos THEN 0 ELSE greatest(g.start_pos - r.end_pos, r.start_pos - g.end_pos) END AS distance,
  row_number() OVER (PARTITION BY r.region ORDER BY CASE WHEN g.start_pos <= r.end_pos AND r.start_pos <= g.end_pos THEN 0 ELSE greatest(g.start_pos - r.end_pos, r.start_pos - g.end_pos) END, g.start_pos, g.end_pos, g.gene_id) AS k
  FROM {regions} r LEFT JOIN {genes} g ON r.chrom = g.chrom) WHERE k = 1""")
def jon_nearest_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.nearest(view(spark, sf_dir, "regions"), view(spark, sf_dir, "genes"), "region", "gene_id")


@query("""SELECT r.region, coalesce(g.gene_id, 'Distal intergenic') AS gene_id, CASE WHEN g.gene_id IS NULL THEN 0 ELSE least(r.end_pos, g.end_pos) - greatest(r.start_pos, g.start_pos) + 1 END AS shared
  FROM {regions} r LEFT JOIN {genes} g ON r.chrom = g.chrom AND r.start_pos <= g.end_pos AND g.start_pos <= r.end_pos""")
def jon_left_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = axis.overlap_join(view(spark, sf_dir, "regions"), view(spark, sf_dir, "genes"), 100, "left")
    shared = F.least("end_pos", "other_end_pos") - F.greatest("start_pos", "other_start_pos") + 1
    return found.select("region", F.coalesce("other_gene_id", F.lit("Distal intergenic")).alias("gene_id"), F.when(F.col("other_gene_id").isNull(), 0).otherwise(shared).cast("long").alias("shared"))


@query("""SELECT r.region, coalesce(string_agg(DISTINCT g.gene_id, ';' ORDER BY g.gene_id), 'intergenic') AS genes FROM {regions} r LEFT JOIN {genes} g ON r.chrom = g.chrom
  AND r.start_pos <= CASE WHEN strand = '-' THEN g.end_pos + 30 ELSE g.end_pos END AND CASE WHEN strand = '+' THEN g.start_pos - 30 ELSE g.start_pos END <= r.end_pos GROUP BY r.region""")
def jon_gene_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.annotate import genes_of_regions

    return genes_of_regions(view(spark, sf_dir, "regions"), view(spark, sf_dir, "genes"), 30, 100)


@query("SELECT q.cell_id, q.sites, coalesce(c.cell_type, 'unknown') AS label, c.sample FROM (SELECT cell_id, count(*) AS sites FROM {sites} GROUP BY cell_id) q LEFT JOIN (SELECT * FROM {cells}) c ON q.cell_id = c.cell_id")
def jon_meta_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = view(spark, sf_dir, "cells")
    qc = matrix.cell_qc(view(spark, sf_dir, "sites")).select("cell_id", "sites")
    return qc.join(meta, "cell_id", "left").select("cell_id", "sites", F.coalesce("cell_type", F.lit("unknown")).alias("label"), "sample")


@query("SELECT * FROM {cells} c WHERE EXISTS (SELECT 1 FROM {sites} s WHERE s.cell_id = c.cell_id AND s.state = 1 AND s.chrom = 'chr7')")
def jon_semi_true_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = view(spark, sf_dir, "sites").filter("state = 1 AND chrom = 'chr7'").select("cell_id")
    return view(spark, sf_dir, "cells").join(hit, "cell_id", "left_semi")


@query("SELECT cell_id, chrom, count(*) AS n FROM {sites} WHERE cell_id NOT IN (SELECT cell_id FROM {cells} WHERE score < 0) GROUP BY cell_id, chrom")
def jon_anti_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop = view(spark, sf_dir, "cells").filter("score < 0").select("cell_id")
    return view(spark, sf_dir, "sites").join(drop, "cell_id", "left_anti").groupBy("cell_id", "chrom").agg(F.count(F.lit(1)).alias("n"))


M = f"m AS ({TILED})"


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.tile_mean(view(spark, sf_dir, "sites"), TILE)


@query(f"WITH {M}, s AS (SELECT region, count(mean) AS covered_cell, avg(mean) AS mean, count(mean) / CAST((SELECT count(*) FROM {{cells}}) AS DOUBLE) AS pct_cell FROM m GROUP BY region) SELECT region, covered_cell, round(mean, 6) AS mean, round(pct_cell, 6) AS pct_cell FROM s WHERE covered_cell >= 10 AND pct_cell <= 0.95")
def flt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matrix.filter_features(tiled(spark, sf_dir), view(spark, sf_dir, "cells").count(), min_n=10, max_pct=0.95)
    return s.select("region", "covered_cell", r6(F.col("mean"), "mean"), r6(F.col("pct_cell"), "pct_cell"))


@query(f"""WITH {M}, q AS (SELECT cell_id, count(*) AS sites, CAST(count(*) FILTER (WHERE state = 1) AS DOUBLE) / count(*) AS level FROM {{sites}} GROUP BY cell_id),
s AS (SELECT cell_id, count(mean) AS n_features, count(mean) / CAST((SELECT count(DISTINCT region) FROM m) AS DOUBLE) AS pct_features FROM m GROUP BY cell_id)
SELECT cell_id, n_features, sites, round(level, 6) AS global_meth_level, round(pct_features, 6) AS pct_features FROM s JOIN q USING (cell_id) WHERE n_features >= 20 AND level BETWEEN 0.2 AND 0.6 AND sites >= 50""")
def flt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tiled(spark, sf_dir)
    n = m.select("region").distinct().count()
    s = matrix.filter_cells(m, matrix.cell_qc(view(spark, sf_dir, "sites")), n, min_n=20, min_level=0.2, max_level=0.6, min_sites=50)
    return s.select("cell_id", "n_features", "sites", r6(F.col("global_meth_level"), "global_meth_level"), r6(F.col("pct_features"), "pct_features"))


@query(f"WITH {M} SELECT region, count(*) FILTER (WHERE mean > 0.5) AS n_cells, round(sum(mean), 6) AS n_counts FROM m GROUP BY region HAVING count(*) FILTER (WHERE mean > 0.5) > 5 AND sum(mean) > 10")
def flt_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.filter_genes(tiled(spark, sf_dir), 0.5, 5, 10.0).select("region", "n_cells", r6(F.col("n_counts"), "n_counts"))


@query(f"WITH f AS ({FRACTION}) SELECT region, covered_cell, round(sr_var, 6) AS sr_var FROM (SELECT region, count(mean) AS covered_cell, CASE WHEN count(relative) > 1 THEN var_pop(relative) END AS sr_var FROM ({RESIDUAL}) GROUP BY region) WHERE sr_var IS NOT NULL ORDER BY round(sr_var, 9) DESC, region LIMIT 50")
def top_hvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matrix.region_stats(residual_matrix(spark, sf_dir)).withColumn("key", F.round("sr_var", 9))
    return matrix.top_variable(s, 50, "key").select("region", "covered_cell", r6(F.col("sr_var"), "sr_var"))


@query(f"""WITH {M}, s AS (SELECT region, count(mean) AS covered_cell FROM m GROUP BY region), r AS (SELECT *, row_number() OVER (ORDER BY covered_cell, region) - 1 AS k, count(*) OVER () AS n FROM s WHERE covered_cell > 0)
SELECT region, covered_cell FROM r WHERE k >= CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AND k < CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) ORDER BY covered_cell DESC, region LIMIT 40""")
def top_trim_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matrix.region_stats(tiled(spark, sf_dir)).select("region", "covered_cell")
    return matrix.trim_quantiles(s, saver(spark, "trim"), "covered_cell", 0.1, 0.05, 40)


@query(f"WITH {M} SELECT cell_id, region, round(CASE WHEN var_pop(mean) OVER w IS NOT NULL THEN (mean - avg(mean) OVER w) / (var_pop(mean) OVER w + 1) END, 6) AS z FROM m WINDOW w AS (PARTITION BY region)")
def sca_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.zscore(tiled(spark, sf_dir)).select("cell_id", "region", r6(F.col("z"), "z"))


@query(f"WITH {M} SELECT cell_id, region, round(CASE WHEN max(mean) OVER w > min(mean) OVER w THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0 END, 6) AS scaled FROM m WINDOW w AS (PARTITION BY cell_id)")
def sca_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.minmax(tiled(spark, sf_dir), "cell_id").select("cell_id", "region", r6(F.col("scaled"), "scaled"))


@query(f"WITH {M} SELECT cell_id, region, mean AS raw, round(ln(1 + mean), 6) AS log1p FROM m")
def sca_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled(spark, sf_dir).select("cell_id", "region", F.col("mean").alias("raw"), r6(F.log1p("mean"), "log1p"))


def _imputed(stat: str) -> str:
    return f"""WITH {M}, s AS (SELECT region, {stat}(mean) AS fill FROM m GROUP BY region), c AS (SELECT DISTINCT cell_id FROM {{cells}})
SELECT c.cell_id, s.region, round(coalesce(m.mean, s.fill), 6) AS value, m.mean IS NULL AS imputed FROM s CROSS JOIN c LEFT JOIN m ON m.cell_id = c.cell_id AND m.region = s.region"""


@query(_imputed("avg"))
def imp_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.impute(tiled(spark, sf_dir), view(spark, sf_dir, "cells"), "mean", 6)


@query(_imputed("median"))
def imp_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.impute(tiled(spark, sf_dir), view(spark, sf_dir, "cells"), "median", 6)

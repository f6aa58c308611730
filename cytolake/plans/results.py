"""Queries on result tables, look-ups, samples and small tables, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sites as S
from ..operators import axis, enrich, matrix, ranked, smooth
from .analysis import ADJUSTED, COSG, LABELLED, SETS, T, adjusted, protein_coding, rows_by_type, tail
from .core import BANDWIDTH, FRACTION, H, SMOOTH, TILE, TILED, half_up, r6, tiled
from .fixtures import view, with_views
from .tables import saver

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_views(sql)
        return f

    return add


LFC = f"SELECT region, grp, round(log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)), 9) AS lfc FROM ({T})"
RESULT = f"SELECT *, row_number() OVER (PARTITION BY grp ORDER BY z DESC, region) AS rank FROM (SELECT a.region, a.grp, a.z, a.p, a.padj, f.lfc FROM ({ADJUSTED}) a JOIN ({LFC}) f ON a.region = f.region AND a.grp = f.grp)"
WITH_RESULT = f"WITH l AS ({LABELLED}), res AS ({RESULT})"


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_result(rows_by_type(spark, sf_dir))


@query(f"{WITH_RESULT} SELECT region, grp, rank, round(z, 6) AS z, round(p, 6) AS p, round(padj, 6) AS padj, round(lfc, 5) AS lfc FROM res")
def dif_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, sf_dir).select("region", "grp", "rank", *[r6(F.col(c), c) for c in ("z", "p", "padj")], F.round("lfc", 5).alias("lfc"))


@query(f"{WITH_RESULT} SELECT region, grp FROM res WHERE padj < 0.95 AND lfc > -0.3 AND lfc < 0.8")
def dif_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.filtered(result(spark, sf_dir), 0.95, -0.3, 0.8).select("region", "grp")


@query(f"{WITH_RESULT} SELECT 'up' AS direction, region, grp FROM res WHERE lfc > 0 UNION ALL SELECT 'down', region, grp FROM res WHERE lfc < 0 UNION ALL SELECT 'all', region, grp FROM res")
def dif_group_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = result(spark, sf_dir)
    parts = [ranked.directed(r, d).select(F.lit(d).alias("direction"), "region", "grp") for d in ("up", "down", "all")]
    return parts[0].union(parts[1]).union(parts[2])


TWO = f"SELECT * FROM ({LABELLED}) WHERE grp IN ('ASIA', 'EUROPE')"


@query(f"""WITH l AS ({TWO}), g AS (SELECT region, grp, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY region, grp),
r AS (SELECT region, grp, sum(r) AS s, count(*) AS n FROM (SELECT region, grp, rank() OVER (PARTITION BY region ORDER BY x) + (count(*) OVER (PARTITION BY region, x) - 1) / CAST(2 AS DOUBLE) AS r FROM l) GROUP BY region, grp)
SELECT a.region, a.n AS n1, b.n AS n2, round((a.m - b.m) / CASE WHEN sqrt(a.v / a.n + b.v / b.n) > 1e-9 THEN sqrt(a.v / a.n + b.v / b.n) END, 6) AS t,
  round((ra.s - ra.n * (ra.n + rb.n + 1) / CAST(2 AS DOUBLE)) / sqrt(ra.n * rb.n * (ra.n + rb.n + 1) / CAST(12 AS DOUBLE)), 6) AS z
FROM g a JOIN g b ON a.region = b.region AND a.grp = 'ASIA' AND b.grp = 'EUROPE' JOIN r ra ON ra.region = a.region AND ra.grp = 'ASIA' JOIN r rb ON rb.region = a.region AND rb.grp = 'EUROPE'""")
def dif_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.pairwise_test(rows_by_type(spark, sf_dir), "ASIA", "EUROPE").select("region", "n1", "n2", r6(F.col("t"), "t"), r6(F.col("z"), "z"))


@query(f"""WITH l AS ({LABELLED}) SELECT f.region, f.grp, round(fc, 6) AS fc FROM (SELECT region, grp, CASE WHEN m2 > 0 THEN m1 / m2 END AS fc FROM ({T})) f
  JOIN (SELECT region, grp, (s - n1 * (n1 + 1) / CAST(2 AS DOUBLE)) / (n1 * (n - n1)) AS auc FROM (SELECT region, grp, sum(r) AS s, count(*) AS n1, any_value(n) AS n FROM (
    SELECT region, grp, count(*) OVER (PARTITION BY region) AS n, rank() OVER (PARTITION BY region ORDER BY x) + (count(*) OVER (PARTITION BY region, x) - 1) / CAST(2 AS DOUBLE) AS r FROM l) GROUP BY region, grp) WHERE n > n1) a
  ON a.region = f.region AND a.grp = f.grp WHERE fc < 0.8 AND abs(auc - 0.5) + 0.5 > 0.55""")
def dif_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.one_vs_rest(rows_by_type(spark, sf_dir), 0.8, 0.55).select("region", "grp", r6(F.col("fc"), "fc"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, region) AS rank FROM ({COSG})) WHERE rank <= floor(100 * 5 / 100)")
def top_marker_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import diff

    scored = diff.cosg(rows_by_type(spark, sf_dir)).withColumn("key", F.round("score", 9))
    return diff.top_per_group(scored, 100 * 5 // 100, "key").select("region", "grp", F.col("rank").cast("long").alias("rank"))


@query(f"{WITH_RESULT} SELECT region, grp, rank FROM res WHERE grp IN ('AFRICA', 'ASIA', 'EUROPE') AND rank <= 4")
def set_union_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.group_tables(result(spark, sf_dir), ["AFRICA", "ASIA", "EUROPE"], 4).select("region", "grp", "rank")


@query(f"{WITH_RESULT} SELECT DISTINCT region FROM res WHERE rank <= 3")
def top_group_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(spark, sf_dir).filter("rank <= 3").select("region").distinct()


@query(f"WITH l AS ({LABELLED}) SELECT region, round(min(p), 6) AS p FROM ({ADJUSTED}) GROUP BY region HAVING min(p) < 0.05")
def flt_least_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.least_over_groups(adjusted(spark, sf_dir), "region", "p", 0.05).select("region", r6(F.col("p"), "p"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, round(p, 6) AS p FROM ({ADJUSTED}) WHERE p < 0.2 ORDER BY p, region, grp LIMIT 10")
def top_smallest_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted(spark, sf_dir).filter("p < 0.2").orderBy("p", "region", "grp").limit(10).select("region", "grp", r6(F.col("p"), "p"))


# enrichment's full table

GENE_LIST = "SELECT term, string_agg(gene_id, ';' ORDER BY gene_id) AS genes FROM (SELECT DISTINCT s.term, s.gene_id FROM {gene_sets} s JOIN {genes} g ON s.gene_id = g.gene_id AND g.gene_type = 'protein_coding') GROUP BY term"
TERMS = f"""SELECT *, least(1.0, min(pval * n_terms / place) OVER (ORDER BY pval DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM (
  SELECT *, count(*) OVER () AS n_terms, count(*) OVER (ORDER BY pval RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM (
    SELECT term, x, k, round({tail('x', 'm', 'k', 'n')}, 9) AS pval, (x + 0.5) * (m - k - n + x + 0.5) / ((k - x + 0.5) * (n - x + 0.5)) AS odds FROM ({SETS}) WHERE x > 0))"""


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = protein_coding(spark, sf_dir)
    return enrich.term_table(genes, view(spark, sf_dir, "gene_sets"))


@query(f"""SELECT e.term, concat(CAST(x AS STRING), '/', CAST(k AS STRING)) AS overlap, round(pval, 6) AS pval, round(padj, 6) AS padj, round(odds, 6) AS odds_ratio, round(-ln(greatest(pval, 1e-300)) * odds, 4) AS combined_score, genes
FROM ({TERMS}) e JOIN ({GENE_LIST}) g ON e.term = g.term""")
def enr_term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = term_table(spark, sf_dir)
    return e.select("term", "overlap", *[r6(F.col(c), c) for c in ("pval", "padj", "odds_ratio")], F.round("combined_score", 4).alias("combined_score"), "genes")


@query(f"SELECT e.term, list_aggregate(string_split(genes, ';')[1:10], 'string_agg', ';') AS genes FROM (SELECT * FROM ({TERMS}) WHERE pval < 0.9 ORDER BY pval, term LIMIT 5) e JOIN ({GENE_LIST}) g ON e.term = g.term")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = term_table(spark, sf_dir).filter("pval < 0.9").orderBy("pval", "term").limit(5)
    return first.select("term", F.array_join(F.slice(F.split("genes", ";"), 1, 10), ";").alias("genes"))


# look-ups


@query("""SELECT region, string_agg(gene, ';' ORDER BY gene) AS genes, count(*) AS n_genes FROM (SELECT DISTINCT r.region, upper(g.gene_name) AS gene FROM {regions} r JOIN {genes} g ON r.chrom = g.chrom AND r.start_pos <= g.end_pos AND g.start_pos <= r.end_pos) GROUP BY region""")
def jon_region_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = view(spark, sf_dir, "genes")
    pairs = axis.overlap_join(view(spark, sf_dir, "regions").select("region", "chrom", "start_pos", "end_pos"), genes.select("chrom", "start_pos", "end_pos", "gene_id"), 100)
    return ranked.region_genes(pairs.select("region", F.col("other_gene_id").alias("gene_id")), genes.select("gene_id", "gene_name"), upper=True)


@query("SELECT s.term, s.gene_id, g.gene_name FROM {gene_sets} s JOIN {genes} g ON s.gene_id = g.gene_id")
def jon_gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "gene_sets").join(view(spark, sf_dir, "genes").select("gene_id", "gene_name"), "gene_id").select("term", "gene_id", "gene_name")


@query("SELECT region, variable, CAST(value AS BIGINT) AS value FROM (SELECT region, 'start_pos' AS variable, start_pos AS value FROM {regions} UNION ALL SELECT region, 'end_pos', end_pos FROM {regions})")
def jon_melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "regions").select("region", F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))
    return r.unpivot("region", ["start_pos", "end_pos"], "variable", "value")


@query("SELECT g.gene_id, row_number() OVER (ORDER BY g.chrom, g.start_pos, g.gene_id) AS rank FROM {genes} g WHERE gene_id IN (SELECT gene_id FROM {gene_sets})")
def jon_gene_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "genes").join(view(spark, sf_dir, "gene_sets").select("gene_id").distinct(), "gene_id", "left_semi")
    return ranked.global_rank(known.select("gene_id", "chrom", "start_pos"), saver(spark, "gene_order"), "chrom", "start_pos", "gene_id").select("gene_id", "rank")


@query("SELECT r.region FROM {regions} r WHERE EXISTS (SELECT 1 FROM {genes} g WHERE g.gene_type = 'lncRNA' AND r.chrom = g.chrom AND greatest(r.start_pos, g.start_pos) < least(r.end_pos, g.end_pos))")
def jon_island_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    islands = view(spark, sf_dir, "genes").filter("gene_type = 'lncRNA'").select("chrom", F.col("start_pos").alias("start_pos"), F.col("end_pos").alias("end_pos"), F.struct("start_pos", "end_pos").alias("island"))
    met = axis.overlap_join(view(spark, sf_dir, "regions").select("region", "chrom", "start_pos", "end_pos", F.struct("start_pos", "end_pos").alias("own")), islands, 100)
    return met.filter(F.greatest("own.start_pos", "island.start_pos") < F.least("own.end_pos", "island.end_pos")).select("region").distinct()


WANTED = ["r900", "r12", "r7", "r1500", "r12", "none"]


@query("SELECT r.region, place FROM {regions} r JOIN (VALUES ('r900', 0), ('r12', 1), ('r7', 2), ('r1500', 3), ('none', 4)) AS w(region, place) ON r.region = w.region")
def flt_region_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.by_list(view(spark, sf_dir, "regions").select("region"), "region", WANTED, spark)


@query("SELECT chrom, count(*) AS n FROM {sites} WHERE chrom NOT IN ('chr1', 'chr7') GROUP BY chrom")
def flt_exclude_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.without_chroms(view(spark, sf_dir, "sites"), ["chr1", "chr7"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cell_id FROM {cells} WHERE cell_id NOT IN (SELECT cell_id FROM {sites} WHERE chrom = 'chr3' AND pos < 30)")
def flt_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = view(spark, sf_dir, "sites").filter("chrom = 'chr3' AND pos < 30").select("cell_id").distinct()
    return view(spark, sf_dir, "cells").select("cell_id").join(done, "cell_id", "left_anti")


# scalar functions


@query("SELECT context, strand, count(*) AS n, CASE context WHEN 'CG' THEN 'five_prime_utr' WHEN 'CGA' THEN 'three_prime_utr' ELSE context END AS feature FROM {sites_raw} GROUP BY context, strand")
def sca_feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("context") == "CG", "5UTR").when(F.col("context") == "CGA", "3UTR").otherwise(F.col("context"))
    return view(spark, sf_dir, "sites_raw").groupBy("context", "strand").agg(F.count(F.lit(1)).alias("n")).withColumn("feature", S.feature_name(named))


@query("SELECT region, greatest(0, start_pos - 500) AS start_pos, end_pos + 200 AS end_pos FROM {regions}")
def sca_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.slop(F.col("start_pos"), F.col("end_pos"), 500, 200)
    return view(spark, sf_dir, "regions").select("region", a.alias("start_pos"), b.alias("end_pos"))


@query("SELECT DISTINCT p_type AS name, upper(regexp_extract(concat(p_type, '::x(var)'), '^([^/:()-]*)', 1)) AS motif, regexp_extract(p_brand, '^([^_]*)', 1) AS id, replace(p_type, ' ', '_') AS factor FROM part")
def sca_motif_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_brand")).distinct()
    i, factor = S.motif_id(F.concat(F.col("p_brand"), F.lit("_"), F.replace("name", F.lit(" "), F.lit("_")), F.lit(".jaspar")))
    return p.select("name", S.motif_name(F.concat(F.col("name"), F.lit("::x(var)"))).alias("motif"), i.alias("id"), factor.alias("factor")).distinct()


@query("SELECT state, CASE state WHEN 0 THEN 'white' WHEN 1 THEN 'red' WHEN -1 THEN 'blue' END AS colour, count(*) AS n FROM {sites} GROUP BY state")
def sca_state_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sites").groupBy("state", S.state_colour(F.col("state")).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat(cell_type, '_', sample) AS category, count(*) AS n FROM {cells} GROUP BY 1")
def sca_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cells").groupBy(S.composite(F.col("cell_type"), F.col("sample")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT term, CASE WHEN len(string_split(genes, ';')) > 3 THEN concat(list_aggregate(string_split(genes, ';')[1:3], 'string_agg', ';'), '...') ELSE genes END AS genes FROM ({GENE_LIST})")
def sca_gene_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "gene_sets").join(protein_coding(spark, sf_dir), "gene_id").select("term", "gene_id").distinct()
    joined = g.groupBy("term").agg(F.array_join(F.sort_array(F.collect_list("gene_id")), ";").alias("genes"))
    return joined.select("term", S.shortened(F.col("genes"), 3).alias("genes"))


@query(f"WITH l AS ({LABELLED}) SELECT region, grp, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM ({ADJUSTED})")
def sca_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted(spark, sf_dir).select("region", "grp", S.stars(F.col("p")).alias("stars"))


@query("SELECT 'quality' AS name, bool_and(quality IN (0, 1)) AS is_binary FROM labels UNION ALL SELECT 'meth', bool_and(meth IN (0, 1)) FROM {sites}")
def sca_is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [view(spark, sf_dir, t).agg(S.is_binary(F.col(c)).alias("is_binary")).select(F.lit(c).alias("name"), "is_binary") for t, c in (("labels", "quality"), ("sites", "meth"))]
    return parts[0].union(parts[1])


# samples


@query("SELECT cell_id FROM {cells} WHERE (CAST(cell_id AS BIGINT) * 2654435761 + 12345) % 4294967296 < CAST(0.3 * 4294967296 AS BIGINT)")
def smp_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.sample_fraction(view(spark, sf_dir, "cells"), "cell_id", 0.3).select("cell_id")


@query("SELECT cell_id FROM {cells} ORDER BY (CAST(cell_id AS BIGINT) * 2654435761 + 12345) % 4294967296, cell_id LIMIT 10")
def smp_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.sample_fixed(view(spark, sf_dir, "cells"), "cell_id", 10).select("cell_id")


@query("SELECT cell_id, CAST(floor((row_number() OVER (ORDER BY cell_id) - 1) / 8) AS BIGINT) AS batch FROM {cells}")
def smp_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked.global_rank(view(spark, sf_dir, "cells").select("cell_id"), saver(spark, "batches"), "cell_id")
    return r.select("cell_id", F.floor((F.col("rank") - 1) / 8).alias("batch"))


# windows, sums


@query("SELECT chrom, s AS start_pos, least(s + 150, length) AS end_pos FROM (SELECT chrom, length, unnest(range(0, length, 50)) AS s FROM {chrom_sizes})")
def win_tiles_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.tiles_from_zero(view(spark, sf_dir, "chrom_sizes"), 150, 50)


@query(f"WITH f AS ({FRACTION}) SELECT v.chrom, v.pos, CASE WHEN v.pos >= {H} AND v.pos + {H} <= m.last + 1 THEN round(value, 6) END AS value FROM ({SMOOTH}) v JOIN (SELECT chrom, max(pos) AS last FROM f GROUP BY chrom) m ON v.chrom = m.chrom")
def win_smooth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = smooth.fractions(view(spark, sf_dir, "sites"))
    return smooth.null_edges(smooth.tricube_smooth(track, BANDWIDTH), BANDWIDTH).select("chrom", "pos", r6(F.col("value"), "value"))


@query("SELECT cell_id, round(avg(CASE WHEN state = -1 THEN 0 ELSE state END) FILTER (WHERE state <> 0 AND cov >= 10), 6) AS mean FROM {sites} WHERE chrom = 'chr2' AND pos >= 0 AND pos < 1000 GROUP BY cell_id")
def agg_column_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.window_level(view(spark, sf_dir, "sites"), "chr2", 0, 1000, 10).withColumn("mean", F.round("mean", 6))


@query(f"""WITH m AS ({TILED}), s AS (SELECT region, avg(mean) AS u, var_pop(mean) AS v FROM m GROUP BY region)
SELECT region, CASE WHEN v > 1e-12 AND v < u * (1 - u) THEN round(u * (u * (1 - u) / v - 1), 4) END AS alpha, CASE WHEN v > 1e-12 AND v < u * (1 - u) THEN round((1 - u) * (u * (1 - u) / v - 1), 4) END AS beta FROM s""")
def agg_beta_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.beta_moments(tiled(spark, sf_dir)).select("region", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


@query(f"WITH m AS ({TILED}) SELECT cell_id, count(*) AS n, floor(CAST(sum(CAST(round(mean * 1000) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(1000 AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS mean FROM m WHERE region IN ('chr1:1-{TILE}', 'chr2:1-{TILE}', 'chr3:1-{TILE}', 'chr4:101-200') GROUP BY cell_id")
def agg_region_set_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matrix.mean_over(tiled(spark, sf_dir), [f"chr{k}:1-{TILE}" for k in (1, 2, 3)] + ["chr4:101-200"])
    return out.select("cell_id", "n", half_up(F.col("mean"), "mean"))


@query("SELECT cell_id, count(*) AS reads, round(count(*) * CAST(150 AS DOUBLE) / (SELECT sum(length) FROM {chrom_sizes}), 6) AS coverage FROM {sites_raw} GROUP BY cell_id")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "sites_raw").groupBy("cell_id").agg(F.count(F.lit(1)).alias("reads"))
    return matrix.average_coverage(reads, view(spark, sf_dir, "chrom_sizes"), 150).withColumn("coverage", F.round("coverage", 6))


@query("SELECT kind, count(*) AS n, round(avg(end_pos - start_pos), 6) AS mean_length, min(end_pos - start_pos) AS shortest, max(end_pos - start_pos) AS longest FROM {regions} GROUP BY kind")
def agg_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.length_report(view(spark, sf_dir, "regions"), "kind").withColumn("mean_length", F.round("mean_length", 6))


@query(f"""WITH l AS ({LABELLED}), g AS (SELECT region, grp, avg(x) AS x FROM l GROUP BY region, grp) SELECT a.grp AS a, b.grp AS b, count(*) AS n, round(corr(a.x, b.x), 5) AS r FROM g a JOIN g b ON a.region = b.region AND a.grp < b.grp GROUP BY a.grp, b.grp""")
def dst_pcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rows_by_type(spark, sf_dir).groupBy("region", "grp").agg(F.avg("x").alias("x"))
    return ranked.correlations(g, "region", "grp", "x").withColumn("r", F.round("r", 5))


@query("SELECT chrom, pos, cell_id, state FROM {sites} WHERE chrom IN ('chr1', 'chr2', 'chr3')")
def set_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "sites").select("chrom", "pos", "cell_id", "state")
    parts = [sites.filter(F.col("chrom") == c) for c in ("chr1", "chr2", "chr3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH l AS ({LABELLED}), n AS (SELECT c.cell_id, c.cell_type, CASE WHEN l.x > 0.2 THEN l.x END AS x FROM {{cells}} c LEFT JOIN l ON l.cell_id = c.cell_id AND l.region = 'chr1:1-{TILE}') SELECT cell_type, cell_id, row_number() OVER (PARTITION BY cell_type ORDER BY x NULLS FIRST, cell_id) AS place FROM n")
def top_plot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tiled(spark, sf_dir).filter(F.col("region") == f"chr1:1-{TILE}").select("cell_id", F.when(F.col("mean") > 0.2, F.col("mean")).alias("x"))
    order = Window.partitionBy("cell_type").orderBy(F.asc_nulls_first("x"), "cell_id")
    return view(spark, sf_dir, "cells").join(one, "cell_id", "left").select("cell_type", "cell_id", F.row_number().over(order).cast("long").alias("place"))

"""Over-representation of gene sets and motifs, by hypergeometric tails in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln(n!), exact by summation up to 20, beyond by Stirling's series (error below 1e-10)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(20)).cast("int"))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.lit(3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, small).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(x: Column, population: Column, successes: Column, draws: Column) -> Column:
    """P(X >= x) of drawing at least x successes."""
    most = F.least(successes, draws)
    low = F.greatest(x, F.lit(0).cast("long"), draws + successes - population)
    term = lambda k: F.exp(log_choose(successes, k) + log_choose(population - successes, draws - k) - log_choose(population, draws))
    total = F.aggregate(F.sequence(low, F.greatest(low, most)), F.lit(0.0), lambda a, k: a + F.when(k <= most, term(k)).otherwise(F.lit(0.0)))
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def set_counts(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """Per term: its genes (k), the listed ones among them (x), all listed (n) and the background (m) of the library."""
    library = sets.select("term", "gene_id").distinct()
    background = library.select("gene_id").distinct()
    listed = genes.select("gene_id").distinct().join(background, "gene_id", "left_semi").withColumn("hit", F.lit(1))
    m, n = background.count(), listed.count()
    out = library.join(listed, "gene_id", "left").groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("x"))
    return out.withColumns({"n": F.lit(n).cast("long"), "m": F.lit(m).cast("long")})


def enrich(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """Terms with their overlap, p-value, odds ratio and combined score."""
    c = set_counts(genes, sets).filter("x > 0")
    p = hypergeometric_tail(F.col("x"), F.col("m"), F.col("k"), F.col("n"))
    a, b = F.col("x") + 0.5, F.col("k") - F.col("x") + 0.5
    odds = a * (F.col("m") - F.col("k") - F.col("n") + F.col("x") + 0.5) / (b * (F.col("n") - F.col("x") + 0.5))
    out = c.withColumns({"pval": p, "odds_ratio": odds})
    return out.withColumn("combined_score", -F.log(F.greatest(F.col("pval"), F.lit(1e-300))) * F.col("odds_ratio"))


def motif_enrichment(regions: DataFrame, chosen: DataFrame, hits: DataFrame) -> DataFrame:
    """Per motif: regions with it inside and outside the chosen ones, and the one-sided exact test."""
    total = regions.select("region").distinct().count()
    picked = chosen.select("region").distinct()
    n = picked.count()
    marked = hits.select("motif_id", "region").distinct().join(regions.select("region").distinct(), "region", "left_semi").join(picked.withColumn("hit", F.lit(1)), "region", "left")
    out = marked.groupBy("motif_id").agg(F.count("hit").alias("both"), F.count(F.lit(1)).alias("with_motif"))
    out = out.withColumns({"only_chosen": F.lit(n) - F.col("both"), "only_motif": F.col("with_motif") - F.col("both")})
    out = out.withColumn("neither", F.lit(total) - F.col("both") - F.col("only_chosen") - F.col("only_motif"))
    return out.withColumn("pval", hypergeometric_tail(F.col("both"), F.lit(total).cast("long"), F.col("with_motif"), F.lit(n).cast("long")))


def term_table(genes: DataFrame, sets: DataFrame) -> DataFrame:
    """Terms with overlap (listed/all), p-value, adjusted p-value, odds ratio, combined score and the listed genes, joined.

    There is a row a term of the library, so the adjustment over all terms is one task's.
    """
    from .diff import bh_adjust

    told = enrich(genes, sets).withColumn("pval", F.round("pval", 9))
    score = -F.log(F.greatest(F.col("pval"), F.lit(1e-300))) * F.col("odds_ratio")
    listed = sets.select("term", "gene_id").distinct().join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    names = listed.groupBy("term").agg(F.array_join(F.sort_array(F.collect_list("gene_id")), ";").alias("genes"))
    overlap = F.concat(F.col("x").cast("string"), F.lit("/"), F.col("k").cast("string"))
    return bh_adjust(told.withColumns({"combined_score": score, "overlap": overlap}), "pval").join(names, "term")

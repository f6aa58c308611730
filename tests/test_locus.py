"""Hand-made cases of gene models, profiles, cut-offs, distances and trees."""

import numpy as np
import pytest

from cytolake.operators import cluster, embed, locus, matrix, ranked
from cytolake.sources import annotations

FEATURES = "chrom string, feature string, start_pos long, end_pos long, strand string, gene_name string, gene_type string"


def test_gene_models(spark):
    a = lambda f, s, e, g: ("chr1", f, s, e, "+", g, "t")
    rows = [a("gene", 50, 300, "over"), a("gene", 120, 160, "in"), a("gene", 180, 260, "right"), a("gene", 90, 110, "left"), a("gene", 201, 300, "out"), a("exon", 100, 130, "lonely")]
    rows += [a("exon", 120, 130, "in"), a("exon", 130, 140, "in"), a("exon", 141, 160, "in"), a("exon", 122, 125, "in")]
    got = {r.gene: r for r in locus.gene_models(spark.createDataFrame(rows, FEATURES), "chr1", 100, 200).collect()}
    assert {g: (r.label_x, r.label_place) for g, r in got.items()} == {"over (t)": (150.0, "top center"), "in (t)": (140.0, "top center"), "right (t)": (180.0, "top right"), "left (t)": (110.0, "top left")}
    assert got["in (t)"].exons == "120-140;141-160" and got["left (t)"].exons == ""


def test_profile_of_one_cluster_and_the_others(spark):
    sites = spark.createDataFrame([(c, "chr1", p, 1 if c == 0 else -1) for c in (0, 1) for p in range(0, 60, 2)], "cell_id int, chrom string, pos long, state int")
    cells = spark.createDataFrame([(0, "x"), (1, "y")], "cell_id int, kind string")
    got = locus.profile(sites, cells, "kind", ["x"], "chr1", 20, 40, 10, 10).collect()
    assert {r.pos for r in got} == set(range(10, 51, 2))
    assert {(r.cluster, r.value) for r in got if 20 <= r.pos <= 40} == {("x", 1.0), ("Others", 0.0)}
    assert len(locus.profile(sites, cells, "kind", ["x", "z"], "chr1", 20, 40, 10, 10).select("cluster").distinct().collect()) == 1


def test_mahalanobis(spark):
    x = np.random.default_rng(1).normal(size=(40, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 3]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, v array<double>")
    inverse = np.linalg.inv(np.cov(x.T))
    got = embed.pairwise(embed.whitened(df, "k", "v"), "id", "v", "euclidean").collect()
    assert len(got) == 40 * 39 // 2
    for r in got:
        e = x[r.i] - x[r.j]
        assert r.d == pytest.approx(np.sqrt(e @ inverse @ e))
    with pytest.raises(ValueError):
        embed.whitened(spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [0.0, 0.0])], "k long, v array<double>"), "k", "v")


def test_cut_offs(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 0.5), (2, 3.0)], "k long, x double")
    assert sorted(r.k for r in matrix.within(df, {"x": (0, 3.0)}).collect()) == [1, 2]
    rates = matrix.pass_rates(df, {"x": 1.0}, {})
    matrix.require_rates(rates)
    with pytest.raises(ValueError):
        matrix.require_rates(rates, 0.9)
    with pytest.raises(ValueError):
        matrix.require_rates(matrix.pass_rates(df.filter("k > 5"), {"x": 1.0}, {}))


def test_trees(spark):
    assert cluster.leaf_order([(0, 2, 1.0, 2), (1, 3, 2.0, 2), (4, 5, 3.0, 4)], 4) == [0, 2, 1, 3]
    values = {"a": [1, 2, 3, 4], "b": [4, 3, 2, 1.5], "c": [1, 2, 3, 5]}
    rows = spark.createDataFrame([(f"r{k}", g, float(x)) for g, v in values.items() for k, x in enumerate(v)], "region string, grp string, x double")
    order = cluster.group_order(rows, "region", "grp", "x")
    assert sorted(order) == ["a", "b", "c"] and abs(order.index("a") - order.index("c")) == 1


def test_resolution_search(spark):
    tried = []

    def find(resolution):
        tried.append(resolution)
        return spark.range(30).selectExpr("id", f"id % {1 + int(resolution * 3)} AS community")

    resolution, labels = cluster.resolution_search(find, 4)
    assert labels.select("community").distinct().count() == 4 == 1 + int(resolution * 3)
    _, near = cluster.resolution_search(find, 20, steps=6)
    assert near.select("community").distinct().count() == 9
    assert tried[0] == 1.5


def test_meta_values(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("cell,sample\na,s1\nb,s2\nc,s1\n")
    assert sorted(r[0] for r in annotations.meta_values(spark, str(tmp_path / "meta.csv")).collect()) == ["s1", "s2"]


def test_beta_moments_from_integers(spark):
    means = {"ones": [0.0] * 2 + [1.0], "more": [0.0] * 4 + [1.0] * 5, "same": [0.3] * 4, "two": [0.2, 0.4, 0.4], "one": [0.5]}
    df = spark.createDataFrame([(r, c, m) for r, x in means.items() for c, m in enumerate(x)], "region string, cell_id int, mean double")
    got = {r.region: (r.alpha, r.beta) for r in ranked.beta_moments(df).collect()}
    assert {r for r, v in got.items() if v == (None, None)} == {"ones", "more", "same", "one"}
    u, v = 1 / 3, 0.08 / 9
    assert got["two"] == pytest.approx((u * (u * (1 - u) / v - 1), (1 - u) * (u * (1 - u) / v - 1)))

"""Hand-made cases of the methylation operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.functions import sites as S
from cytolake.operators import annotate, axis, cluster, denovo, diff, embed, enrich, matrix, smooth, views

SITES = "cell_id int, chrom string, pos long, meth long, cov long, state int"


@pytest.fixture(scope="module")
def two_cells(spark):
    rows = [(0, "chr1", p, 1, 1, s) for p, s in ((10, 1), (20, -1), (30, 0), (40, 1))] + [(1, "chr1", p, 1, 1, s) for p, s in ((10, 1), (20, 1))]
    return spark.createDataFrame(rows, SITES)


def test_region_mean_ignores_ambiguous_and_missing(spark, two_cells):
    regions = spark.createDataFrame([("a", "chr1", 1, 50), ("b", "chr1", 31, 31), ("c", "chr9", 1, 50), ("d", "chr1", 25, 35)], "region string, chrom string, start_pos long, end_pos long")
    got = {(r.cell_id, r.region): (r["mean"], r.n_obs) for r in matrix.region_matrix(two_cells, regions).collect()}
    assert got == {(0, "a"): (0.667, 3), (1, "a"): (1.0, 2)}


def test_range_join_edges(spark):
    s = spark.createDataFrame([("chr1", p) for p in (8, 9, 19, 20)], "chrom string, pos long")
    r = spark.createDataFrame([("x", "chr1", 10, 20)], "region string, chrom string, start_pos long, end_pos long")
    assert sorted(x.pos for x in axis.range_join(s, r, 4).collect()) == [9, 19]
    assert sorted(x.pos for x in axis.range_join(s, r, 4, half_open=True).collect()) == [9]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(s,) for s in [1] + [-1] * 15], "state int")
    assert df.agg(matrix.mean_of(F.col("state"))).first()[0] == 0.062


@pytest.mark.parametrize("block", [1000, 100_000])
def test_constant_track_is_kept(spark, block):
    track = spark.createDataFrame([("chr1", p, 4, 0.5) for p in range(0, 3000, 7)], "chrom string, pos long, n_obs long, mfrac double")
    out = smooth.tricube_smooth(track, 200, block=block).collect()
    assert len(out) == len(range(0, 3000, 7)) and all(abs(r.value - 0.5) < 1e-12 for r in out)


def test_blocks_do_not_change_the_smooth_track(spark):
    rng = np.random.default_rng(1)
    track = spark.createDataFrame([("chr1", int(p), int(n), float(v)) for p, n, v in zip(sorted(rng.choice(5000, 400, False)), rng.integers(1, 9, 400), rng.random(400))], "chrom string, pos long, n_obs long, mfrac double")
    for f in (lambda b: smooth.tricube_smooth(track, 300, block=b), lambda b: smooth.adaptive_smooth(track, 5, 200, block=b)):
        one, two = ({r.pos: r.value for r in f(b).collect()} for b in (250, 1_000_000))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_nearest_of_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 64)
    x = np.random.default_rng(7).integers(0, 3, (300, 4)).astype(float) + [0, 0, 0, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    d = np.round(embed.distances(x, x, "euclidean"), 9)
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), d[i]))[:5])}
    assert {(r.i, r["rank"]): (r.j, r.d) for r in embed.neighbours(df, "k", "v", 5, "euclidean").collect()} == want


def test_communities_of_a_small_graph_take_few_tables(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (400, 2)) if a != b and (a // 12 == b // 12 or rng.random() < 0.1)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src long, dst long, weight double")
    tables = []

    def save(frame, name):
        tables.append(name)
        frame.write.parquet(f"{tmp_path}/{len(tables)}")
        return spark.read.parquet(f"{tmp_path}/{len(tables)}")

    near = cluster.communities(df, save)
    levels = sum(n.startswith("found") for n in tables)
    assert len(tables) == 2 + 4 * levels + 1 and sorted(r.id for r in near.collect()) == sorted({x for p in pairs for x in p})
    monkeypatch.setattr(cluster, "LOCAL_EDGES", 0)  # rounds over all nodes at once
    assert cluster.modularity(df, near) > cluster.modularity(df, cluster.communities(df, save)) - 0.02


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_imputed_rows_are_not_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(matrix, "CELLS_PER_LIST", 4)
    monkeypatch.setattr(matrix, "BROADCAST_CELLS", limit)
    rows = [(c, f"r{k}", (7 * c + k) % 11 / 10) for k in range(40) for c in range(-1, 12) if (c * 31 + k * 17) % 5 == 0]  # cell -1 is no cell
    m = spark.createDataFrame([*rows, (None, "r0", 0.5)], "cell_id int, region string, mean double")
    cells = spark.createDataFrame([(c,) for c in [*range(12), 3, None]], "cell_id int")
    frame = matrix.impute(m, cells, "median")
    known = {(c, r): x for c, r, x in rows}
    of = {r: [x for _, q, x in [*rows, (None, "r0", 0.5)] if q == r] for _, r, _ in rows}
    want = {(c, r): (known[c, r], False) if (c, r) in known else (round(float(np.median(x)), 9), True) for r, x in of.items() for c in [*range(12), None]}
    got = frame.collect()
    assert len(got) == len(want) and {(r.cell_id, r.region): (round(r.value, 9), r.imputed) for r in got} == want
    # above the rows that unfold into the dense matrix there is no join, sort or exchange
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not {"Join", "Aggregate", "Repartition", "Sort"} & {w for line in plan.split("Generate explode(concat")[0].splitlines() for w in line.split()}
    assert "Generate explode(concat" in plan


@pytest.mark.parametrize("block", [7, 50_000])
def test_nearest_by_force(spark, block):
    rng = np.random.default_rng(4)
    spans = lambda n, name, width: [(f"{name}{k}", f"c{rng.integers(0, 3)}", int(s), int(s + rng.integers(0, width))) for k, s in enumerate(rng.integers(-50, 150, n))]
    regions = [*spans(120, "r", 6), ("alone", "c9", 1, 2)]
    genes = spans(25, "g", 9)
    genes += [(f"{g}x", c, s, e) for g, c, s, e in genes[:5]] + [("only", "c8", 1, 2)]
    cut = lambda rows, name: spark.createDataFrame(rows, f"{name} string, chrom string, start_pos long, end_pos long")
    frame = axis.nearest(cut(regions, "region"), cut(genes, "gene_id"), "region", "gene_id", block)
    want = {}
    for r, c, s, e in regions:
        found = [(0 if gs <= e and s <= ge else max(gs - e, s - ge), gs, ge, g) for g, gc, gs, ge in genes if gc == c]
        want[r] = (min(found)[3], min(found)[0]) if found else (None, None)
    assert {r.region: (r.gene_id, r.distance) for r in frame.collect()} == want


def test_nearest_looks_back_only(spark):
    """A frame to the end of a partition is computed anew for each row, in time that grows with the square."""
    one = lambda name: spark.createDataFrame([("a", "c", 1, 2)], f"{name} string, chrom string, start_pos long, end_pos long")
    plan = axis.nearest(one("region"), one("gene_id"), "region", "gene_id")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_merge_and_gaps(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 5, 8), ("c", 2, 3), ("c", 10, 11)], "chrom string, start_pos long, end_pos long")
    assert sorted((r.start_pos, r.end_pos, r.n_merged) for r in axis.merge_intervals(df).collect()) == [(1, 8, 3), (10, 11, 1)]
    pos = spark.createDataFrame([("c", p) for p in (1, 2, 30, 31, 99)], "chrom string, pos long")
    assert sorted((r.start_pos, r.end_pos) for r in axis.gap_regions(pos, 10).collect()) == [(1, 2), (30, 31)]


def test_step_track_has_one_change_point():
    assert denovo.change_points(np.r_[np.full(50, 0.1), np.full(50, 0.9)]) == [(0, 50), (50, 100)]
    assert denovo.change_points(np.full(80, 0.5)) == [(0, 80)]
    assert denovo.thin(iter([1, 3, 9, 10, 20]), 5) == [1, 9, 20]


def test_bh_adjust(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.02, 0.03, 0.5)], "p double")
    assert sorted(round(r.padj, 6) for r in diff.bh_adjust(df, "p").collect()) == [0.04, 0.04, 0.04, 0.5]


def test_normal_p_and_hypergeometric(spark):
    got = spark.range(1).select(diff.normal_p(F.lit(1.959963985)), enrich.hypergeometric_tail(F.lit(2), F.lit(10), F.lit(4), F.lit(3))).first()
    exact = sum(math.comb(4, k) * math.comb(6, 3 - k) for k in (2, 3)) / math.comb(10, 3)
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] == pytest.approx(exact)
    big = spark.range(1).select(enrich.log_factorial(F.lit(1000))).first()[0]
    assert big == pytest.approx(math.lgamma(1001), rel=1e-12)


def test_linkage_of_four_points():
    x = np.array([[0.0], [1.0], [10.0], [11.0]])
    d = np.abs(x - x.T)
    for method, last in (("single", 9.0), ("complete", 11.0), ("average", 10.0), ("weighted", 10.0)):
        merges = cluster.linkage(d, method)
        assert [m[:2] for m in merges] == [(0, 1), (2, 3), (4, 5)] and merges[-1][2] == pytest.approx(last)
    assert cluster.cut_tree(cluster.linkage(d), 4, 2) == [0, 0, 1, 1]
    assert cluster.linkage(d, "ward")[0][2] == pytest.approx(1.0)


def test_two_cliques(spark, tmp_path):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10, 0.2)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")

    def save(t, name):
        t.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    labels = cluster.communities(df, save)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [10, 11, 12, 13]]
    assert cluster.modularity(df, labels) > 0.4


def test_no_two_communities_gain_by_joining(spark, tmp_path):
    pairs = [(i, (i + 1) % 32) for i in range(32)]
    df = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "src long, dst long, weight double")

    def save(t, name):
        t.write.mode("error").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    label = {r.id: r.community for r in cluster.communities(df, save).collect()}
    size = {c: 2 * sum(v == c for v in label.values()) for c in label.values()}
    between = {frozenset((label[a], label[b])) for a, b in pairs if label[a] != label[b]}
    assert between
    for a, b in map(tuple, between):
        shared = sum({label[x], label[y]} == {a, b} for x, y in pairs)
        assert shared <= size[a] * size[b] / 64


def test_distances_and_ranks():
    x = np.array([[1.0, 2.0, 2.0, 5.0]])
    assert embed._ranks(x).tolist() == [[1.0, 2.5, 2.5, 4.0]]
    with pytest.raises(ValueError):
        embed.distances(-x, x, "bhattacharyya")
    with pytest.raises(ValueError):
        embed.distances(x, x, "nothing")


def test_introns_and_genes(spark):
    exons = spark.createDataFrame([("t", 1, 10), ("t", 21, 30), ("u", 5, 6)], "transcript_id string, start_pos long, end_pos long")
    assert [(r.start_pos, r.end_pos) for r in annotate.introns(exons).collect()] == [(11, 20)]
    rows = spark.createDataFrame([("chr1", "a", 1, 10), ("chr1", "b", 5, 20), ("chr1", "c", 100, 120)], "chrom string, gene_id string, start_pos long, end_pos long")
    lines = {r.gene_id: r.line for r in views.pack_rows(rows, 5).collect()}
    assert lines == {"c": 0, "b": 0, "a": 1}


def test_chrom_names_and_states(spark):
    df = spark.createDataFrame([("chr1",), ("X",)], "c string")
    got = [tuple(r) for r in df.select(*[S.chrom_name(F.col("c"), k) for k in ("add_chr", "remove_chr", "keep", "bare_upper")]).collect()]
    assert got == [("chr1", "1", "chr1", "1"), ("chrX", "X", "X", "X")]
    share = spark.createDataFrame([(0.9,), (0.1,), (0.5,), (None,)], "x double").select(S.trinarise(F.col("x"))).collect()
    assert [r[0] for r in share] == [1, -1, 0, None]
    with pytest.raises(ValueError):
        S.chrom_name(F.lit("x"), "other")


def test_motif_scan(spark):
    from cytolake.operators import motifs

    counts = np.zeros((4, 6))
    for k, c in enumerate("ACGTTA"):
        counts["ACGT".index(c), k] = 20
    rows = [("a", "ttttACGTTAtt"), ("b", "ccTAACGTcc"), ("c", "nn"), ("d", None)]
    hits = motifs.scan(spark.createDataFrame(rows, "region string, sequence string"), {"m": counts}, 1e-3)
    assert sorted((r.region, r.pos, r.strand) for r in hits.collect()) == [("a", 4, "+"), ("b", 2, "-")]
    assert motifs.hit_matrix(hits).count() == 2


def test_logistic_components_lower_the_loss():
    from cytolake.operators import logistic_pca as L

    rng = np.random.default_rng(3)
    theta = 4 * np.outer(rng.choice([-1, 1], 60), np.r_[np.ones(10), np.zeros(10)])
    x = (rng.random(theta.shape) < L.sigmoid(theta)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    mu, a, b = L.fit(x, 1, 1.0)
    assert L.loss(x, mu + a @ b.T) < 0.7 * L.loss(x, np.broadcast_to(mu, x.shape))
    assert np.abs(b[:10]).min() > 3 * np.abs(b[10:]).max()
    assert L.choose_penalty(x, 1, (0.5, 1e6))[0] == 0.5

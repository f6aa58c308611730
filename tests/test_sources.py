"""File readers, writers and the streaming extension on small files."""

import gzip

import pytest

from cytolake.sources import annotations as A
from cytolake.sources import coverage as C
from cytolake.sources import genomes, sinks
from cytolake.streaming import ingest


def test_formats():
    assert C.resolve("bismark").is_total is False and C.resolve("bsseeker2").is_total is True
    f = C.resolve("1:2:5:6c:4:tab:1")
    assert (f.chrom, f.pos, f.meth, f.other, f.context, f.is_total, f.sep, f.header) == (0, 1, 4, 5, 3, True, "\t", True)
    assert C.resolve("1:2:3:,:0").other is None
    for bad in ("nothing", "1:2:3", "1:2:5:6x:4:tab:1", "a:2:3:,:0"):
        with pytest.raises(ValueError):
            C.resolve(bad)


def test_scan_skips_and_reports(spark, tmp_path):
    lines = ["# comment", "", "chr1\t10\t+\t9\t1\tCG\tCGA", "1\t20\t-\t0\t4\tCGN\tCGT", "chr1\t30\t+\t1\t1\tCHH\tCAA", "chr1\tx\t+\t1\t1\tCG\tCGA", "chr1\t40", "chr2\t5\t+\t0\t0\tCG\tCGG"]
    with gzip.open(tmp_path / "cellA.cov.gz", "wt") as f:
        f.write("\n".join(lines))
    scanned = C.scan(spark, str(tmp_path))
    assert {r.bad for r in scanned.filter("bad IS NOT NULL").collect()} == {"no position", "too few columns"}
    got = sorted((r.cell_name, r.chrom, r.pos, r["cov"], r.state) for r in C.sites(scanned).collect())
    assert got == [("cellA", "chr1", 10, 10, 1), ("cellA", "chr1", 20, 4, -1)]
    assert C.sites(scanned, cg=False).count() == 1 and C.sites(scanned, cg=None, min_cov=0).count() == 4


def test_ratio_files_and_ids(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("chr1,5,0.95\nchr1,7,0.1\n")
    (tmp_path / "a.tsv").write_text("chr1,5,0.5\nchr1,5,0.5\n")
    rows = C.with_cell_ids(C.sites(C.scan(spark, str(tmp_path), "1:2:3:,:0"), "1:2:3:,:0"))
    assert sorted((r.cell_id, r.state) for r in rows.collect()) == [(0, 0), (0, 0), (1, -1), (1, 1)]


def test_duplicates_are_added_up(spark):
    rows = spark.createDataFrame([(0, "c", 1, 1, 10), (0, "c", 1, 19, 10)], "cell_id int, chrom string, pos long, meth long, cov long")
    assert [(r.meth, r["cov"], r.state) for r in C.merge_duplicates(rows).collect()] == [(20, 20, 1)]


def test_sniff(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("\n".join(f"chr1\t{1000 + i}\t+\t{i % 5}\t{5 - i % 5}\tCG" for i in range(80)))
    f = C.sniff(spark, str(p))
    assert (f.chrom, f.pos, f.meth, f.other, f.context, f.header) == (0, 1, 3, 4, 5, False)


def test_regions_genes_sets(spark, tmp_path):
    (tmp_path / "r.bed").write_text("chr1 1 10 a\nchr1 1 10 a\nchr2\t5\t9\n")
    assert sorted(tuple(r) for r in A.load_regions(spark, str(tmp_path / "r.bed")).collect()) == [("chr1", 1, 10, "a"), ("chr2", 5, 9, "chr2:5-9")]
    with pytest.raises(ValueError):
        A.load_regions(spark, "x.gff")
    (tmp_path / "g.gtf").write_text(
        '#h\n1\ts\tgene\t100\t200\t.\t-\t.\tgene_id "G1"; gene_name "N1"; gene_type "protein_coding";\n2\ts\tgene\t5\t9\t.\t+\t.\tgene_id "G2"; gene_biotype "lncRNA";\n1\ts\texon\t1\t2\t.\t+\t.\tgene_id "G1";\n'
    )
    g = A.gtf(spark, str(tmp_path / "g.gtf"))
    assert [(r.chrom, r.gene_id, r.gene_name) for r in g.collect()] == [("chr1", "G1", "N1")]
    assert [(r.start_pos, r.end_pos) for r in A.tss_windows(g, 10, 5).collect()] == [(195, 210)]
    assert A.gtf(spark, str(tmp_path / "g.gtf"), gene_type="all", exclude=("chr1",)).count() == 1
    (tmp_path / "s.gmt").write_text("T1\td\tA\tB\nT2\td\tA\n")
    assert A.gmt(spark, str(tmp_path / "s.gmt")).count() == 3
    (tmp_path / "c.sizes").write_text("chr1\t100\nchr2\t50\n")
    assert [r.length for r in A.chrom_sizes(spark, str(tmp_path / "c.sizes"), ("chr2",)).collect()] == [100]
    (tmp_path / "f.fa").write_text(">chr1 x\nACgt\nTT\n>chr2\nGG\n")
    seqs = A.fasta(spark, str(tmp_path / "f.fa"))
    assert sorted((r.chrom, r.sequence) for r in seqs.collect()) == [("chr1", "ACgtTT"), ("chr2", "GG")]
    r = spark.createDataFrame([("x", "chr1", 2, 5)], "region string, chrom string, start_pos long, end_pos long")
    assert A.region_sequences(seqs, r).first().sequence == "CGTT"
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 0.5\n2 1 3\n")
    assert sorted(tuple(x) for x in A.triplets(spark, str(tmp_path / "m.mtx")).collect()) == [(1, 1, 0.5), (2, 1, 3.0)]
    assert genomes.chrom_sizes(spark, "hg38").count() == 24


def test_sites_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "chr1", 5, 1), (1, "chr2", 6, -1)], "cell_id int, chrom string, pos long, state int")
    sinks.write_sites(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("chrom = 'chr2'").count() == 1
    sinks.write_matrix(rows, rows, rows, str(tmp_path / "m"))
    assert [t.count() for t in sinks.read_matrix(spark, str(tmp_path / "m"))] == [2, 2, 2]


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("c1\tchr1\t5\t9\t1\tCG\nc1\tchr1\t6\t1\t9\tCHH\nc2\tchr1\t5\t0\t3\tCGA\n")
    q = ingest.qc_stream(ingest.site_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("qc_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.cell_name, r.sites, r.meth) for r in spark.table("qc_rows").collect()) == [("c1", 1, 1), ("c2", 1, 0)]

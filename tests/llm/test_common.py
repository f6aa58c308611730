"""Cases that every operator has to take: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import zlib

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from cytolake.llm import common, fingerprints, jaccard, mixing, packing, passages, pii, pieces, quality, toxicity, urls
from cytolake.llm.queries import tokenizer

LONG = " ".join(f"word{i % 977} and{i % 13}." for i in range(20_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One short line"), (4, "One short line"), (5, LONG), (6, "é😀\u3000x ▁ <|endoftext|> +1 (988) 555-2485"), (None, "no id here at all"), (7, "x" * 30_000), (8, "1" * 5_000)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(4, 0), (None, 1), (99, None)], "doc_id long, toxic int")
    return {
        "pii": lambda d: pii.find(d, pii.train(d)),
        "passages": lambda d: passages.marked(spark, d),
        "toxicity": lambda d: toxicity.classify(d, labels),
        "packing": lambda d: packing.pack(spark, d, tokenizer("word_bpe_49k.json")),
        "jaccard": lambda d: jaccard.join(spark, d),
        "pieces": lambda d: pieces.encode_decode(d, tokenizer("piece_bpe_32k.model")),
        "quality": lambda d: quality.judge(d),
        "fingerprints": lambda d: fingerprints.compare_edited(spark, d),
        "mixing": lambda d: mixing.score(spark, d),
    }


NAMES = ["pii", "passages", "toxicity", "packing", "jaccard", "pieces", "quality", "fingerprints", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_are_all_answered(spark, odd, name):
    out = operators(spark)[name](odd)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    if name == "packing":
        assert set(ids) == {r[0] for r in ODD}
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ODD), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    assert operators(spark)[name](none).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_with_clashing_names(spark, name):
    clash = {c: F.lit("x") for c in ("n", "v", "block", "kept", "score", "spans", "rank", "key", "train", "fp", "gone", "n_words", "removed", "clean_text", "hub", "length", "toxic")}
    docs = spark.createDataFrame([(1, "a b c d e f."), (2, "a b c d e f."), (3, "g h i")], SCHEMA).withColumns(clash)
    plain = operators(spark)[name](docs.select("doc_id", "text"))
    got = operators(spark)[name](docs)
    rows = lambda df: sorted(str(r) for r in df.select(*sorted(plain.columns)).collect())
    assert rows(got) == rows(plain)


def test_pages_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.org/es/x?y"), (4, "http://EXAMPLE.org/es/x?y"), (5, "://"), (6, "x://a..org//"), (None, "http://z.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "h", "key")})
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark, pages, urls.default_rules(spark)).collect()), key=str)
    assert got == sorted(
        [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.org", "/es/x", "example.org/es/", "block"), (4, "example.org", "/es/x", "example.org/es/", "block"), (5, "", "", None, "allow"),
         (6, "a..org", "//", "org/", "allow"), (None, "z.com", "/de/", "com/de/", "block")], key=str)
    assert urls.judge(spark, pages.limit(0), urls.default_rules(spark)).count() == 0
    assert {r.verdict for r in urls.judge(spark, pages, urls.default_rules(spark).limit(0)).collect()} == {"allow"}


def test_remainder_is_crc32(spark):
    got = spark.range(50).select("id", common.remainder(F.col("id"), 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)


@pytest.mark.parametrize("most", [2, 4096])
def test_id_blocks_keep_order(spark, most):
    docs = spark.createDataFrame([(x,) for x in (5, 1, 9, 900, 901, 10**12, None, 7, 7, 3)], "doc_id long")
    rows = docs.select("doc_id", common.id_blocks(docs, "doc_id", 2, most).alias("b")).filter("doc_id IS NOT NULL").orderBy("doc_id").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows if r.doc_id == 7}) == 1


def test_a_worker_gives_memory_back_after_a_task():
    pinned, rss = [], lambda: psutil.Process().memory_info().rss / 1e6

    def run(batches):
        for _ in batches:
            held = [np.ones(12_000) for _ in range(1500)]  # 144 MB in pieces that the allocator keeps
            pinned.append(np.ones(12_000))
            yield len(held)

    def group(table):
        return list(run([table]))

    begun = rss()
    assert list(common.lean(run)([0])) == common.lean(group)(0) == [1500]
    assert rss() - begun < 40
    assert list(run([0])) == [1500] and rss() - begun > 100  # so it was before
    common.give_back()
    assert rss() - begun < 40

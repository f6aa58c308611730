"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, mixing, packing, passages, pieces, pii, quality, toxicity, urls
from .common import documents, read_table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(docs))


def op3_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(spark, pages, urls.default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.marked(spark, documents(spark, sf_dir))
    return found.select("doc_id", "n_units", "n_removed", "removed")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "chars_removed"
    )


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(spark, documents(spark, sf_dir))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(spark, documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_line_hashing": op2_line_hashing,
    "op3_bloom_cascade": op3_bloom_cascade,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_multiset_hash": op9_multiset_hash,
    "op10_context_mixing": op10_context_mixing,
}

"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next one, so a lost executor costs at most a
part of one stage.

Defined cases: a null text counts as an empty one; the quality rules reject
both, so later stages meet them only when called by themselves, and keep them.
Rows with a null id or a repeated one go through every stage like others (the
stages never join texts by id).  An empty table gives an empty result.  Columns
besides doc_id and text are carried along under their own names, whatever these are.

A stage bounds the session's batches (``BATCHES``) and leaves them so, as its
result is computed later; ``run`` sets them back.  No result depends on them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import jaccard, packing, passages, pii, quality
from cytolake.llm.common import Stage, read_table
from cytolake.llm.queries import tokenizer

#: Bytes that Spark and a Python worker hand each other at once, and rows that a reader unpacks at once; by default the former are 10,000 texts.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Words in each generation of a packing worker's memory; an idle worker keeps them while later stages run.
WORDS = 150_000


def small_batches(step: Callable) -> Callable:
    """A stage that bounds the session's batches before it begins."""

    @wraps(step)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in BATCHES.items():
            spark.conf.set(key, most)
        return step(spark, docs, sf_dir)

    return bounded


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no name of theirs meets a name that a stage adds."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))


def unboxed(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``boxed``'s input, with ``text`` replaced and n_chars counted anew."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])


@small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines; null and empty texts go."""
    return unboxed(quality.keep(boxed(docs)), docs.columns, F.col("clean_text"))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that with the smallest id.

    Rows that share an id, but are not linked, all stay; of rows that repeat id
    and text one does.  Rows without words are linked with nothing and stay.
    """
    return jaccard.keep_one(spark, docs)


@small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the passages that occur earlier; rows without an id come last."""
    return unboxed(passages.clean(spark, boxed(docs)), docs.columns, F.col("text"))


@small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    return unboxed(pii.redact(boxed(docs), pii.train(docs)), docs.columns, F.col("text"))


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(spark, docs.select("doc_id", "text"), tokenizer("word_bpe_49k.json"), words=WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The random field and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    stage = Stage(spark, "pipeline")
    done: list[str] = []
    found = {key: spark.conf.get(key) for key in BATCHES}
    try:
        for name, step in STAGES:
            docs = stage.save(step(spark, docs, sf_dir), name)
            for before in done:
                stage.drop(before)
            done = [name]
    finally:
        for key, value in found.items():
            spark.conf.set(key, value)
    return docs

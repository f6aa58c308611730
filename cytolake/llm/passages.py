"""Substring dedup by hashing normalised units of lines.

A line is cut into units that end with a sentence of at least ``CLOSING``
words (shorter sentences go with the one after them) or with the line.  A unit
is normalised (A-Z lower-cased, ASCII punctuation dropped, white space made
single) and hashed to 128 bits; units of fewer than ``LEAST`` words are never
removed.  Over all documents, the occurrence of a digest with the smallest
(doc_id, unit) stays and every other one is removed, with its offsets in the
original text (code points, end exclusive) retained.

Digests are reduced to their first occurrence by partial aggregation, so a
passage that a third of all documents share costs one row a task; only digests
found at least twice are looked up again, in a join whose hot partitions Spark
splits.

Defined cases: a null text has no units and stays null; empty texts stay as
they are; rows that repeat both doc_id and text count as one document, so they
keep the same units; an occurrence in a row without doc_id comes first; other
columns are passed through by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, aside, lean

#: Words of a sentence that closes a unit.
CLOSING = 5
#: Words of the shortest unit that can be removed.
LEAST = 5
SENTENCE_END = re.compile(r"(?<=[.!?]) |\n")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DELETE = PUNCTUATION.encode()


def units(text: str) -> list[tuple[int, int, bytes]]:
    """Start, end and normalised words of the text's units, in order; blank ones are left out."""
    out = []
    start = at = 0  # of the unit, of the sentence
    held: list[bytes] = []
    for m in [*SENTENCE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        words = text[at:end].encode("utf-8", "surrogatepass").lower().translate(None, _DELETE).split()
        held += words
        at = m.end() if m else end
        if m is None or m.group() == "\n" or len(words) >= CLOSING:
            if held:
                out.append((start, end, b" ".join(held)))
            held = []
            start = at
    return out


def digest(unit: bytes) -> bytes:
    return hashlib.blake2b(unit, digest_size=16).digest()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, unit's number and the two halves of its digest, of every unit that can be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, found = [], [], []
            for k, x in enumerate(batch.column("text")):
                for i, (_, _, u) in enumerate(units(x.as_py() or "")):
                    if u.count(b" ") >= LEAST - 1:
                        row.append(k)
                        number.append(i)
                        found.append(digest(u))
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "unit", "h1", "h2"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, unit int, h1 long, h2 long")


def removals(stage: Stage, docs: DataFrame) -> DataFrame:
    """doc_id and the (unit, h1) of the units to remove from it."""
    found = digests(docs)
    first = F.struct("doc_id", "unit")
    twice = found.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.max(first).alias("last")).filter(F.col("first") != F.col("last"))
    twice = stage.save(twice.select("h1", "h2", "first"), "twice")
    later = found.join(twice, ["h1", "h2"]).filter(F.struct("doc_id", "unit") != F.col("first"))
    return later.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit", "h1"))).alias("_gone_units"))


ADDED = "n_units long, n_removed long, removed string, clean_text string"
ADDED_NAMES = ["n_units", "n_removed", "removed", "clean_text"]


def marked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with n_units, n_removed, the removed spans (start:end, comma-joined) and clean_text.

    Input columns of these names are called ``input_...`` in the result.
    """
    stage = Stage(spark, "passages")
    docs, _ = aside(docs, ADDED_NAMES)
    gone = stage.save(removals(stage, docs), "removals")
    joined = docs.join(gone.withColumnRenamed("doc_id", "_of"), F.col("doc_id").cast("long").eqNullSafe(F.col("_of")), "left").drop("_of")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, clean = [], [], [], []
            for x, g in zip(batch.column("text"), batch.column("_gone_units"), strict=True):
                text, g = x.as_py(), g.as_py()
                us = units(text or "")
                mine = {e["unit"]: e["h1"] for e in g or ()}
                cut = [us[i][:2] for i, h in mine.items() if i < len(us) and int.from_bytes(digest(us[i][2])[:8], "little", signed=True) == h]
                total.append(len(us))
                removed.append(len(cut))
                spans.append(",".join(f"{a}:{b}" for a, b in cut))
                clean.append(without(text, cut) if cut else text)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.string()), pa.array(clean, pa.string())],
                names=[*names, "n_units", "n_removed", "removed", "clean_text"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(lean(run), f"{fields}, {ADDED}")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, each with the separator after it (or, at the end, before it)."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = min(len(text), b + 1)
    left = "".join([*out, text[at:]])
    return left[:-1] if spans and spans[-1][1] == len(text) and left[-1:] in (" ", "\n") else left


def clean(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the removed units out of their texts; the same columns."""
    out = marked(spark, docs)
    _, told = aside(docs, ADDED_NAMES)
    return out.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"`{told[c]}`").alias(c) for c in docs.columns])


def sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)

"""Helpers that the training-data operators share.

Words are maximal runs of characters other than the six ASCII white-space
characters; every operator takes a null text for an empty one.
"""

from __future__ import annotations

import ctypes
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Used only where the session names no shared folder and runs on one machine, as in tests.
ONE_MACHINE = "/tmp/checkpoints"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``; nothing else is read from the files."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (named or ONE_MACHINE).rstrip("/")


class Stage:
    """Intermediate tables of one run, in a folder of their own under the shared one.

    A written table cuts the lineage: what is lost with an executor is read
    again instead of being computed again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a table; ``by`` names a column whose values get a folder each (``name/by=value``), to be dropped one by one."""
        return self._written(df, f"{self.root}/{name}", by)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Write a run's result beside its other tables, and remove these."""
        out = self._written(df, f"{self.root}-{name}")
        self.drop()
        return out

    def _written(self, df: DataFrame, path: str, by: str | None = None) -> DataFrame:
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Let Spark remove the shuffle files of tables that are written; else they stay until the driver happens to collect its garbage."""
        for _ in range(2):  # after one pass they are all still there, as was seen
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Remove a table that nothing will read any more (all of them without a name)."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system; the allocators of a Python worker would keep it as long as the worker waits for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` of mapInArrow or applyInArrow (one table, or two of a cogroup), giving its memory back after each task or group."""

    def batches_in(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    def one(table):
        try:
            return run(table)
        finally:
            give_back()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    if inspect.isgeneratorfunction(run):
        return batches_in
    return one if len(inspect.signature(run).parameters) == 1 else two


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct numbers, ascending."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def packed(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed byte place by byte place, after their size."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return x.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names called ``input_...`` instead, and what every column is called now."""
    told = {}
    for c in docs.columns:
        to = c
        while to in names or (to != c and to in docs.columns):
            to = f"input_{to}"
        told[c] = to
    return docs.withColumnsRenamed({c: to for c, to in told.items() if c != to}), told


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_left(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def unsigned(signed: Column) -> Column:
    """The 32-bit pattern of an int as an unsigned long."""
    return signed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by).cast("long"))


def id_blocks(docs: DataFrame, key: str, rows: int, most: int = 4096) -> Column:
    """Number of the block that a row's key falls in: about ``rows`` rows each, in ascending order of the keys.

    The blocks' bounds are approximate quantiles over all rows, ``most`` of
    them at most; where that is too few, each is cut evenly by key.  Ties stay
    together and a null key is in the first block.
    """
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if not found["n"] or found["lo"] is None:
        return F.lit(0).cast("long")
    coarse = max(1, min(most, -(-found["n"] // rows)))
    cuts = [i / coarse for i in range(1, coarse)]
    inner = docs.agg(F.percentile_approx(key, cuts, max(10_000, 8 * coarse)).alias("q")).first()["q"] if cuts else []
    bounds = sorted({found["lo"], *inner})
    fine = max(1, -(-found["n"] // (rows * len(bounds))))
    steps = max(1, (len(bounds) - 1).bit_length())
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])

    def place(e: Column) -> Column:
        powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
        at = F.aggregate(powers, F.lit(0), lambda a, p: F.when(F.get(e, a + p) <= F.col(key), a + p).otherwise(a))
        if fine == 1:
            return at.cast("long")
        ends = F.coalesce(F.get(e, at + 1), F.lit(found["hi"] + 1).cast("long"))
        lo = F.get(e, at)
        part = F.floor((F.col(key) - lo).cast("double") / (ends - lo).cast("double") * fine)
        return at.cast("long") * fine + F.greatest(F.lit(0).cast("long"), F.least(part, F.lit(fine - 1).cast("long")))

    return F.coalesce(let(edges, place), F.lit(0).cast("long"))

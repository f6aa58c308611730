"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A paragraph (a line with a word) is hashed to a wide vector: two exact lanes
from the whole paragraph and 120 lanes of one bit from each of its pieces (runs
of at most four words that end with a sentence).  A document's fingerprint is
the sum of its paragraphs' vectors modulo powers of two, so it doesn't depend
on the order of the paragraphs, and a paragraph is inserted or deleted by
adding or subtracting its vector (``add``, ``remove``).

The bits taken as +1 and -1 make the sums a random projection of the multiset
of pieces; the cosine-like ratio of two sums estimates how much two documents
share (``likeness``, 0 to 1).

Defined cases: a null or empty text has the all-zero fingerprint, and two of
them have likeness 1; equal texts always have equal fingerprints; ties of
doc_id are ordered by text; a null doc_id comes first; repeated rows are each
other's next documents.  Beyond 2**20 pieces a lane carries into the next one:
sums stay exact modulo 2**60, only the likeness gets coarser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, id_blocks, let

#: At most four words; a word with . ! or ? ends its piece; never over a line end.
PIECE = r"(?:[^\s.!?]+[ \t]+){0,3}[^\s]+"
LANE_BITS = 20
LANES_PER_LONG = 3
SEEDS = (0, 1)
#: One bit in each lane.
SPREAD = sum(1 << (LANE_BITS * i) for i in range(LANES_PER_LONG))
MODULUS_BITS = LANE_BITS * LANES_PER_LONG
MASK = (1 << MODULUS_BITS) - 1
LANE_MASK = (1 << LANE_BITS) - 1
#: Lanes before the projection: paragraphs' exact sums (two), number of paragraphs, number of pieces.
HEAD = 4
#: Rows of a block in which the next document is looked up.
BLOCK_ROWS = 4096


def long(n: int) -> Column:
    return F.lit(n).cast("long")


def total(values: Column, of) -> Column:
    """Sum of ``of(value)`` modulo 2**60."""
    return F.aggregate(values, long(0), lambda a, x: (a + of(x)).bitwiseAND(long(MASK)))


def fingerprint(text: Column) -> Column:
    """Array of longs: the fingerprint's lanes, three to a long in the projection."""
    t = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(t, "\n"), lambda p: p.rlike(r"[^\s]"))
    pieces = F.regexp_extract_all(t, F.lit(PIECE), F.lit(0))

    def projected(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(LANE_BITS - 1)), lambda k: total(h, lambda x: F.call_function("shiftrightunsigned", x, k).bitwiseAND(long(SPREAD))))

    def hashed(xs: Column, seed: int) -> Column:
        return F.transform(xs, lambda x: F.xxhash64(x, F.lit(seed)))

    def head(ps: Column) -> list[Column]:
        return [total(hashed(ps, s), lambda h: h.bitwiseAND(long(MASK))) for s in SEEDS] + [F.size(ps).cast("long")]

    lead = let(paragraphs, lambda ps: F.array(*head(ps)))
    lanes = let(
        pieces,
        lambda xs: F.concat(F.array(F.size(xs).cast("long")), *[let(hashed(xs, s), projected) for s in SEEDS]),
    )
    return F.concat(lead, lanes)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(long(MASK)))


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of what is left of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y + long(MASK + 1)).bitwiseAND(long(MASK)))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 15, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of pieces in common, as the projection estimates it; exactly 1 for equal fingerprints."""
    na, nb = F.get(a, F.lit(HEAD - 1)), F.get(b, F.lit(HEAD - 1))

    def lane(x: Column, j: int, n: Column) -> Column:
        return (F.shiftrightunsigned(x, LANE_BITS * j).bitwiseAND(long(LANE_MASK)) * 2 - n).cast("double")

    def products(x: Column, y: Column) -> Column:
        both = square = None
        for j in range(LANES_PER_LONG):
            p, q = lane(x, j, na), lane(y, j, nb)
            both = p * q if both is None else both + p * q
            square = p * p + q * q if square is None else square + p * p + q * q
        return F.struct(both.alias("both"), square.alias("square"))

    body = lambda v: F.slice(v, HEAD + 1, LANE_BITS * len(SEEDS))
    zero = F.struct(F.lit(0.0).alias("both"), F.lit(0.0).alias("square"))
    ratio = F.aggregate(
        F.zip_with(body(a), body(b), products),
        zero,
        lambda s, x: F.struct((s["both"] + x["both"]).alias("both"), (s["square"] + x["square"]).alias("square")),
        lambda s: F.when(s["square"] > 0, s["both"] * 2 / s["square"]).otherwise(F.lit(0.0)),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def with_next(spark: SparkSession, docs: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): the next document in ascending doc_id, the first after the last.

    Documents are dealt by blocks of neighbouring ids, so a window of a block
    finds all but the block's last successor; that is the first document of
    the next block, from a table of one row a block.
    """
    block = id_blocks(docs, "doc_id", BLOCK_ROWS)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), block.alias("block"))
    # one id per block, written so that its size is known to the planner of the join
    firsts = stage.save(keyed.groupBy("block").agg(F.min("doc_id").alias("first_id")), "first_ids")
    null_first = keyed.filter(F.col("doc_id").isNull()).select("block", "doc_id", "text")
    heads = keyed.join(firsts.select(F.col("block").alias("b"), "first_id"), F.col("doc_id") == F.col("first_id")).select("block", "doc_id", "text")
    heads = heads.unionByName(null_first).groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    heads = stage.save(heads.select("block", F.col("head.text").alias("head_text")), "heads")
    order = Window.orderBy("block")  # one short row a block, of some thousand documents
    chain = heads.select("block").withColumn("to", F.lead("block").over(order))
    chain = chain.withColumn("to", F.coalesce("to", F.min("block").over(Window.partitionBy())))
    follow = chain.join(heads.select(F.col("block").alias("to"), "head_text"), "to").select("block", "head_text")
    follow = stage.save(follow.withColumn("head_fp", fingerprint(F.col("head_text"))), "follow")
    w = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    inner = keyed.withColumn("fp", fingerprint(F.col("text"))).withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)})
    return inner.join(follow, "block", "left").select(
        "doc_id", "text", "fp", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_fp", "head_fp").alias("next_fp")
    )


def compare_edited(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (second half from the next document), and their likeness."""
    rows = with_next(spark, docs, Stage(spark, "fingerprints"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

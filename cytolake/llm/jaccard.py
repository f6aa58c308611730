"""Exact Jaccard join of documents' five-word shingle sets, and its components.

Shingles are put in one global order: those that no other set has, then the
others by the number of sets that have them.  Two sets with Jaccard similarity
s share at least k of their first ``n - ceil(s * n) + k`` shingles, and of what
they share, at most what lies behind the first shared place of either set.
With k = 2, either the first shared shingle is rare, so single rare shingles
are keys; or the first two are frequent, and pairs of frequent shingles are
keys.  A set with many frequent shingles in its prefix (a member of a large
group of near copies) gives these singly, and the others give theirs singly as
well, to meet such sets only.  A key carries the number of shingles from its
place on; a pair that meets in it can be linked only if both numbers reach the
overlap that their sizes ask for.  A set whose prefix nobody else touches has
no key.  As unshared shingles come first, members of a group that differ too
much from everything else drop out here, however large the group is.

The counts are exact and nothing of them is broadcast.  A task numbers its
documents in blocks, and sends each distinct shingle of a block once to the
shingle's range; the range tells each block what others have as well.  This is
done in two rounds: first with the lowest three eighths of the hashes of all
documents, which is enough to see that most sets have too many shingles of
their own to be linked with any other set; then with all shingles of the rest,
one set of each group of equal ones.

A key's bucket is not expanded into pairs.  Its members are verified against
one of them (the hub), and those linked are one component; this is repeated
with other hubs while many members of a bucket are apart.  At last each member
outside its bucket's largest component is paired with the members of other
components.  This is exact: a pair within a component needs no link of its own.

Defined cases: null or empty texts, and texts without words, have an empty set
and are linked with nothing; a text of one to four words has one shingle;
repeated rows have equal sets and are linked; rows that share a doc_id but not
their set are linked only as their sets are; a null doc_id gets the component
of its equals (null without any).  Shingle hashes have 64 bits, sets 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, distinct, lean, packed, unpacked
from .graph import components

WORDS = 5
#: Similarity of a link, in hundredths.
PERCENT = 80
#: Shingles that two linked sets share in their extended prefixes.
TOGETHER = 2
#: A set with more frequent shingles in its prefix gives them singly.
DENSE = 12
#: A shingle is frequent with this many sets.
FREQUENT = 48
#: The first round takes shingles whose hash is below this: three eighths of all.
SAMPLE = 3 << 61
#: Shingles and sets of a block (places have 16 bits), and shingles of a range, about.
BLOCK_SHINGLES, BLOCK_SETS, RANGE_SHINGLES = 1 << 20, (1 << 16) - 1, 1 << 20
#: Bytes of text for each shingle of the first round, about.
SAMPLE_BYTES = 16
#: Place of a shingle that several sets of its block have.
SEVERAL = (1 << 16) - 1
#: Hubs are taken again while the pairs of a bucket that are apart are so many times its members.
APART = 4
#: Pairs with one hub that are verified in one task.
HUB_PAIRS = 4096
#: Members of a bucket that an outsider meets in one task.
BUCKET_PART = 8192
#: Sets that a task remembers while it verifies pairs.
HELD_SETS = 500
#: Most rows sent to the executors at once; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and their inverses."""
    if len(_POWERS[0]) < n:
        size = max(n + n // 8, 1 << 15)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_FACTORS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    if n < WORDS:
        return mix(np.array([np.sum(w * _FACTORS[:n], dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    h = w[: n - WORDS + 1] * _FACTORS[0]
    for k in range(1, WORDS):
        h = h + w[k : n - WORDS + 1 + k] * _FACTORS[k]
    return distinct(mix(h))


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that tell a set of shingles."""
    return int(np.sum(s, dtype=np.uint64)).to_bytes(8, "big") + int(np.sum(mix(s ^ np.uint64(_ODD)), dtype=np.uint64)).to_bytes(8, "big")


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it is linked with."""
    return -(-percent * n // 100)


def has_partners(n: int, percent: int) -> bool:
    """Whether a set of n can be linked with a set of another size; smaller ones are linked with equal sets only."""
    return 100 * n >= percent * (n + 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(a) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def class_of(h: np.ndarray) -> np.ndarray:
    """What of a shingle's hash is counted: its upper 48 bits."""
    return h >> np.uint64(16)


def range_of(classes: np.ndarray, ranges: int, top: int) -> np.ndarray:
    """The range of each class; ``top`` is the end of all hashes."""
    return ((classes >> np.uint64(16)) * np.uint64(ranges) // np.uint64(top >> 32)).astype(np.int64)


def cell_rows(classes: np.ndarray, notes: np.ndarray, ranges: int, top: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, classes, notes) of a block's ascending classes, cut by ranges and packed."""
    at = range_of(classes, ranges, top)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else [0]
    for f, e in zip(cuts, cuts[1:]):
        yield int(at[f]), packed(np.diff(classes[f:e], prepend=np.uint64(0))), notes[f:e].tobytes()


def classes_of(row: bytes) -> np.ndarray:
    """The classes that ``cell_rows`` packed."""
    return np.cumsum(unpacked(row), dtype=np.uint64)


def block_number(count: int, bits: int) -> int:
    """A number that no other block of this pass has."""
    return TaskContext.get().partitionId() << bits | count


def batch_of(fields: dict[str, pa.DataType], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in fields.items()], names=list(fields))


FIRST = {"block": pa.int64(), "place": pa.int32(), "owner": pa.int32(), "key": pa.int64(), "doc_id": pa.int64(), "g": pa.binary(), "n": pa.int64(), "own": pa.int64(), "range": pa.int64(), "classes": pa.binary(), "notes": pa.binary()}
FIRST_SCHEMA = "block long, place int, owner int, key long, doc_id long, g binary, n long, own long, range long, classes binary, notes binary"


def first_round(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of two kinds: documents in blocks (range is null), and the sampled classes of a block in a range (key is null).

    Equal sets of a block are one; ``owner`` is the place of the first of
    them, and ``own`` the number of its sampled classes that no other set of the block has.
    The notes are the places of the classes' owners.
    """
    most_shingles, most_sets = BLOCK_SHINGLES, BLOCK_SETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held: list[np.ndarray] = []
        owners: dict[bytes, int] = {}
        places: list[int] = []
        size = blocks = 0

        def block() -> pa.RecordBatch:
            nonlocal size, blocks
            number = block_number(blocks, 30)
            classes, owner = np.concatenate([np.zeros(0, np.uint64), *held]), np.repeat(np.array(places, dtype=np.int64), [len(x) for x in held])
            order = np.argsort(classes, kind="stable")
            classes, owner = classes[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])) if len(classes) else order
            alone = np.diff(first, append=len(classes)) == 1
            classes, owner = classes[first], np.where(alone, owner[first], SEVERAL)
            own = np.bincount(owner[alone], minlength=len(rows))
            for r in rows:
                r |= {"block": number, "own": int(own[r["place"]])}
            rows.extend({"block": number, "range": r, "classes": c, "notes": o} for r, c, o in cell_rows(classes, owner.astype("<u2"), ranges, SAMPLE))
            out = batch_of(FIRST, rows)
            for x in (rows, held, owners, places):
                x.clear()
            size, blocks = 0, blocks + 1
            return out

        for batch in batches:
            for key, doc_id, x in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingles(x.as_py() or "")
                g, place = fingerprint(s), len(rows)
                if owners.setdefault(g, place) == place and has_partners(len(s), PERCENT_LEAST):
                    held.append(distinct(class_of(s[: np.searchsorted(s, np.uint64(SAMPLE))])))
                    places.append(place)
                    size += len(held[-1])
                rows.append({"place": place, "owner": owners[g], "key": key, "doc_id": doc_id, "g": g, "n": len(s)})
                if size >= most_shingles or len(rows) >= most_sets:
                    yield block()
        if rows:
            yield block()

    return docs.select("key", "doc_id", "text").mapInArrow(lean(run), FIRST_SCHEMA)


#: The least similarity that the join takes: below it, sets that share one shingle only could be linked.
PERCENT_LEAST = 67


def known_elsewhere(cells: DataFrame) -> DataFrame:
    """(block, places): for every class that several blocks have, the place of its owner in each block where it has only one."""

    def run(table: pa.Table) -> pa.Table:
        classes = [classes_of(x.as_py()) for x in table.column("classes")]
        place = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("notes")])
        row = np.repeat(np.arange(len(classes)), [len(c) for c in classes])
        classes = np.concatenate(classes)
        order = np.argsort(classes, kind="stable")
        again = classes[order][1:] == classes[order][:-1]
        shared = np.zeros(len(classes), dtype=bool)
        shared[order[1:][again]] = shared[order[:-1][again]] = True
        shared &= place != SEVERAL
        found = [(b, place[lo:hi][shared[lo:hi]]) for b, lo, hi in zip(table.column("block").to_pylist(), *spans(row, table.num_rows), strict=True)]
        found = [(b, p.tobytes()) for b, p in found if len(p)]
        return pa.Table.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["block", "places"])

    return cells.select("block", "range", "classes", "notes").groupBy("range").applyInArrow(lean(run), "block long, places binary")


def spans(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each of n runs in an ascending array of their numbers."""
    return np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")


def undecided(found: DataFrame, elsewhere: DataFrame, percent: int) -> DataFrame:
    """(g, key, n): sets with too few shingles of their own to be sure that they are linked with no other set."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, n, own = (left.column(c).to_numpy().astype(np.int64) for c in ("place", "n", "own"))
        back = np.frombuffer(b"".join(right.column("places").to_pylist()), "<u2").astype(np.int64)
        own = own - np.bincount(back, minlength=int(place.max(initial=0)) + 1)[place]
        # without the shingles of its own, such a set can still reach the least overlap
        keep = (place == left.column("owner").to_numpy()) & (100 * n >= percent * (n + 1)) & (own <= n + (-percent * n // 100))
        return left.filter(pa.array(keep)).select(["g", "key", "n"])

    columns = found.select("block", "place", "owner", "g", "key", "n", "own")
    return columns.groupBy("block").cogroup(elsewhere.groupBy("block")).applyInArrow(lean(run), "g binary, key long, n long")


SECOND = {"block": pa.int64(), "v": pa.int64(), "g": pa.binary(), "n": pa.int64(), "shingles": pa.binary(), "range": pa.int64(), "classes": pa.binary(), "notes": pa.binary()}
SECOND_SCHEMA = "block long, v long, g binary, n long, shingles binary, range long, classes binary, notes binary"


def second_round(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of two kinds: the sets of the wanted documents as vertices, in blocks (range is null), and the classes of a block in a range, with how many sets of the block have them."""
    most_shingles, most_sets = BLOCK_SHINGLES // 2, BLOCK_SETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held: list[np.ndarray] = []
        size = blocks = 0

        def block() -> pa.RecordBatch:
            nonlocal size, blocks
            number = block_number(blocks, 20)
            for place, r in enumerate(rows):
                r |= {"block": number, "v": number << 16 | place}
            classes, times = np.unique(np.concatenate([distinct(class_of(s)) for s in held]), return_counts=True)
            rows.extend({"block": number, "range": r, "classes": c, "notes": t} for r, c, t in cell_rows(classes, times.astype("<u2"), ranges, 1 << 64))
            out = batch_of(SECOND, rows)
            for x in (rows, held):
                x.clear()
            size, blocks = 0, blocks + 1
            return out

        for batch in batches:
            for g, x in zip(batch.column("g").to_pylist(), batch.column("text"), strict=True):
                s = shingles(x.as_py() or "")
                if fingerprint(s) != g:  # another text with this row's key
                    continue
                rows.append({"g": g, "n": len(s), "shingles": s.tobytes()})
                held.append(s)
                size += len(s)
                if size >= most_shingles or len(rows) >= most_sets:
                    yield block()
        if rows:
            yield block()

    return docs.select("g", "text").mapInArrow(lean(run), SECOND_SCHEMA)


def shared_counts(cells: DataFrame) -> DataFrame:
    """(block, classes, counts): the classes of each block that at least two sets have, with the number of these."""

    def run(table: pa.Table) -> pa.Table:
        classes = [classes_of(x.as_py()) for x in table.column("classes")]
        times = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("notes")]).astype(np.int64)
        row = np.repeat(np.arange(len(classes)), [len(c) for c in classes])
        classes = np.concatenate(classes)
        _, inverse = np.unique(classes, return_inverse=True)
        total = np.bincount(inverse, weights=times).astype(np.int64)[inverse]
        found = []
        for b, lo, hi in zip(table.column("block").to_pylist(), *spans(row, table.num_rows), strict=True):
            keep = total[lo:hi] > 1
            if keep.any():
                found.append((b, classes[lo:hi][keep].tobytes(), total[lo:hi][keep].tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "classes", "counts"])

    return cells.select("block", "range", "classes", "notes").groupBy("range").applyInArrow(lean(run), "block long, classes binary, counts binary")


#: Kinds of keys: a rare shingle; a frequent one of a set that gives pairs, or of a dense set; a pair.
RARE, SPARSE, DENSE_ONE, PAIR = 0, 1, 2, 3


def prefix_keys(s: np.ndarray, classes: np.ndarray, counts: np.ndarray, percent: int, frequent: int = FREQUENT, most: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set's extended prefix, how many of its shingles lie from each key's place on, and the keys' kinds.

    ``classes`` (ascending) and ``counts`` tell what at least two sets have;
    those of ``frequent`` sets or more are frequent, and a set with over ``most`` of them is dense.
    """
    n = len(s)
    single = n - least_overlap(n, percent) + 1
    at = np.minimum(np.searchsorted(classes, class_of(s)), max(0, len(classes) - 1))
    shared = np.flatnonzero(classes[at] == class_of(s)) if len(classes) else np.zeros(0, dtype=np.int64)
    often = counts[at[shared]] if len(shared) else np.zeros(0, dtype=np.int64)
    order = np.lexsort((s[shared], often))[: max(0, single + TOGETHER - 1 - (n - len(shared)))]
    h, often = s[shared][order], often[order]
    place = n - len(shared) + np.arange(len(h))
    rare = (often < frequent) & (place < single)
    keys, left, kinds = [h[rare]], [n - place[rare]], [np.full(np.count_nonzero(rare), RARE, dtype=np.int8)]
    common, where = h[often >= frequent], place[often >= frequent]
    if len(common):
        dense = len(common) > most
        begin = where < single
        keys.append(mix(common[begin] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        left.append(n - where[begin])
        kinds.append(np.full(np.count_nonzero(begin), DENSE_ONE if dense else SPARSE, dtype=np.int8))
        if not dense:
            i, j = np.triu_indices(len(common), 1)
            keys.append(mix(common[i] * np.uint64(3) + mix(common[j])))
            left.append(n - where[j] + 1)
            kinds.append(np.full(len(i), PAIR, dtype=np.int8))
    return np.concatenate(keys), np.concatenate(left), np.concatenate(kinds)


def bucket_rows(sets: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """A row a key of each vertex: key, v, the set's size n, its shingles from the key's place on, and the key's kind."""
    frequent, most = FREQUENT, DENSE

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        classes, total = (np.frombuffer(b"".join(right.column(c).to_pylist()), t) for c, t in (("classes", "<u8"), ("counts", "<i8")))
        order = np.argsort(classes)
        classes, total = classes[order], total[order]
        out: list[tuple[np.ndarray, ...]] = []
        for v, x in zip(left.column("v").to_pylist(), left.column("shingles"), strict=True):
            s = np.frombuffer(x.as_py(), "<u8")
            k, rest, kinds = prefix_keys(s, classes, total, percent, frequent, most)
            out.append((k.view(np.int64), np.full(len(k), v), np.full(len(k), len(s)), rest, kinds))
        types = {"key": np.int64, "v": np.int64, "n": np.int64, "rest": np.int64, "kind": np.int8}
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *(r[i] for r in out)]).astype(t)) for i, t in enumerate(types.values())], names=list(types))

    return sets.select("block", "v", "shingles").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(lean(run), "key long, v long, n long, rest long, kind byte")


def meet(a: str, b: str, percent: int) -> Column:
    """Whether two members of a bucket may be linked: what lies behind the key reaches the overlap that their sizes ask for."""
    x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
    reach = F.least(x("rest"), y("rest")) * (100 + percent) >= (x("n") + y("n")) * percent
    return reach & ~((x("kind") == SPARSE) & (y("kind") == SPARSE))


def small(rows: DataFrame) -> DataFrame:
    """The rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def verified(stage: Stage, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (src, dst) whose sets are linked.  The set of a src is sent once for each ``HUB_PAIRS`` pairs of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (src, x, y) in enumerate(zip(batch.column("src").to_pylist(), batch.column("x"), batch.column("y"), strict=True)):
                if src not in held:
                    if len(held) >= HELD_SETS:
                        held.clear()
                    held[src] = np.frombuffer(x.as_py(), "<u8")
                keep[i] = linked(held[src], np.frombuffer(y.as_py(), "<u8"), percent)
            yield batch.filter(pa.array(keep)).select(["src", "dst"])

    pairs = stage.save(pairs, f"{name}_pairs")
    parts = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts"))
    first = parts.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(sets.select(F.col("v").alias("src"), F.col("shingles").alias("x")), "src")
    second = pairs.join(parts, "src").withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")))
    second = second.join(sets.select(F.col("v").alias("dst"), F.col("shingles").alias("y")), "dst").select("src", "part", "dst", "y")
    both = second.join(first, ["src", "part"])
    return stage.save(both.select("src", "dst", "x", "y").mapInArrow(lean(run), "src long, dst long"), name)


def star_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a bucket's hub with the members that are in other components (c).

    At first the hub is the member with the most shingles behind the key, which
    is likely to be nearest to all others; in later turns each bucket has one by chance.
    """
    order = F.struct((F.col("n") - F.col("rest")).alias("at"), F.col("v").alias("by")) if turn == 0 else F.struct(F.lit(0).alias("at"), F.xxhash64("key", "v", F.lit(turn)).alias("by"))
    hub = F.struct((F.col("kind") == SPARSE).alias("sparse"), order.alias("order"), *[F.col(c).alias(f"hub_{c}") for c in ("v", "c", "n", "rest", "kind")])
    hubs = rows.groupBy("key").agg(F.min(hub).alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key", "hub.*")
    met = rows.select("key", *[F.col(c).alias(f"own_{c}") for c in ("v", "c", "n", "rest", "kind")]).join(hubs, "key")
    return met.filter((F.col("own_c") != F.col("hub_c")) & meet("own_", "hub_", percent)).select(F.col("hub_v").alias("src"), F.col("own_v").alias("dst")).distinct()


def pairs_across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of bucket members of different components that may be linked.

    Members outside the bucket's largest component meet all others, which are
    dealt to parts of a bounded size.
    """
    sizes = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    heads = sizes.groupBy("key").agg(F.max(F.struct("m", "c")).alias("most"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    heads = heads.select("key", F.col("most.c").alias("main"), F.ceil(F.col("all") / BUCKET_PART).alias("parts"))
    open_ = rows.join(heads, "key")
    fields = ("v", "c", "n", "rest", "kind")
    outside = open_.filter("c <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = outside.select("key", "part", *[F.col(x).alias(f"a_{x}") for x in fields])
    right = open_.select("key", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), (F.col("c") == F.col("main")).alias("inside"), *[F.col(x).alias(f"b_{x}") for x in fields])
    other = (F.col("a_c") != F.col("b_c")) & (F.col("inside") | (F.col("a_v") < F.col("b_v")))
    met = left.join(right, (left["key"] == right["key"]) & (left["part"] == right["part"]) & other & meet("a_", "b_", percent))
    return met.select(F.least("a_v", "b_v").alias("src"), F.greatest("a_v", "b_v").alias("dst")).distinct()


def apart(rows: DataFrame) -> tuple[int, int]:
    """Pairs of bucket members in different components, and members of such buckets."""
    sizes = rows.groupBy("key", "c").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("key")
    found = sizes.agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("within"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    r = found.agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
    return int(r["pairs"] or 0), int(r["rows"] or 0)


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of both."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def classes(stage: Stage, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row a document: key (of its id and text), doc_id, n_shingles, class (of linked documents; null for an empty set) and component_id."""
    if not PERCENT_LEAST <= percent <= 100:
        raise ValueError(f"a similarity of {PERCENT_LEAST} to 100 hundredths is wanted")
    docs = row_key(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = stage.save(first_round(docs, max(1, -(-size // (SAMPLE_BYTES * RANGE_SHINGLES)))), "first")
    signed = found.filter("range IS NULL").select("key", "doc_id", "g", "n")
    rest = undecided(found.filter("range IS NULL"), known_elsewhere(found.filter("range IS NOT NULL")), percent)
    wanted = stage.save(rest.groupBy("g").agg(F.min("key").alias("key"), F.min("n").alias("n")), "wanted")
    total = wanted.agg(F.sum("n")).first()[0] or 0
    chosen = docs.join(small(wanted.select("key", "g")), "key")
    if signed.groupBy("key").count().filter("count > 1").limit(1).count():
        chosen = chosen.dropDuplicates(["key"])
    second = stage.save(second_round(chosen, max(1, -(-total // RANGE_SHINGLES))), "second")
    sets, cells = second.filter("range IS NULL").select("block", "v", "g", "n", "shingles"), second.filter("range IS NOT NULL")
    rows = stage.save(bucket_rows(sets, shared_counts(cells), percent), "keys")
    heads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("kind").alias("last")).filter(f"size > 1 AND last <> {SPARSE}").select("key")
    rows = stage.save(rows.join(heads, "key"), "buckets")
    labels = linked_components(stage, rows, sets, percent)
    # the smallest id of each set, and of each component
    sets_of = signed.filter("n > 0").groupBy("g").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("times"))
    near = labels.join(sets.select(F.col("v").alias("id"), "g"), "id").groupBy("g").agg(F.min("root").alias("root"))
    of_root = near.join(sets_of, "g").select("root", "g", "d")
    least = of_root.groupBy("root").agg(F.min("d").alias("component_id"), F.min("g").alias("class"))
    many = sets_of.filter("times > 1").join(of_root, "g", "left_anti").select("g", F.col("d").alias("component_id"), F.col("g").alias("class"))
    named = stage.save(of_root.join(least, "root").select("g", "component_id", "class").union(many), "named")
    out = signed.join(small(named), "g", "left").select(
        "key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class", "g")).alias("class"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return stage.only(out, "documents")


def linked_components(stage: Stage, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, root) of the vertices that are linked with any other."""

    def labelled(labels: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("id").alias("v"), "root"), "v", "left").withColumn("c", F.coalesce("root", "v")).drop("root")

    links = verified(stage, star_pairs(rows.withColumn("c", F.col("v")), 0, percent), sets, percent, "star_0")
    turn = 0
    while True:
        labels = components(stage, links, f"c{turn}")
        own = stage.save(labelled(labels), f"own_{turn}")
        pairs, members = apart(own)
        if pairs <= APART * members:
            break
        turn += 1
        more = verified(stage, star_pairs(own, turn, percent), sets, percent, f"star_{turn}")
        links = links.union(more)
        if not more.limit(1).count():
            break
    if pairs:
        links = links.union(verified(stage, pairs_across(own, percent), sets, percent, "across"))
        labels = components(stage, links, "all")
    return labels


def join(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    stage = Stage(spark, "jaccard")
    return classes(stage, docs, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All columns of one document of each group of linked ones.

    The row with the smallest doc_id stays (one with an id before one
    without), of rows with this id the one whose id and text have the smallest
    hash; of rows that repeat both, the one whose columns have the smallest
    hash.  Rows that share a doc_id, but are not linked, all stay, and so do
    all rows without words.
    """
    stage = Stage(spark, "keep_one")
    found = classes(stage, docs, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    best = found.filter("class IS NOT NULL").groupBy("class").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("class", F.col("first.key").alias("best"))
    gone = stage.save(found.join(small(best), "class").filter("key <> best").select("key").distinct(), "gone")
    again = stage.save(found.filter("class IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "again")
    name = "key"
    while name in docs.columns:
        name = f"_{name}"
    gone, again = gone.withColumnRenamed("key", name), again.withColumnRenamed("key", name)
    kept = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), "text")).join(small(gone), name, "left_anti")
    if again.limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        rows = kept.join(small(again), name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
        kept = kept.join(small(again), name, "left_anti").select(*columns).unionByName(rows.select("row.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

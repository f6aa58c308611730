"""Packing token sequences by non-negative least squares over the length histogram.

A document's ids (its text's, then the end id) are cut into whole windows and
one tail.  Tail lengths are rounded up to classes of ``QUANTUM`` tokens; all
combinations of up to ``DEPTH`` classes that fill a window exactly are
enumerated, and non-negative least squares finds how often to use each so that
the histogram is used up.  The counts are rounded down, and what is left over
is packed greedily (largest class first, into the smallest gap that takes it).

The plan is made from the histogram alone (a row a class), whatever the number
of documents.  A tail finds its place by its rank within its class: the ranks
come from counts by (class, salt), so a class that holds a third of all tails
is spread over many tasks; the places are looked up in arrays that hold a few
entries a pattern.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each by itself; nothing comes of an empty table.  Sequences are numbered
from 0 and hold their pieces without gaps.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, lean

WINDOW = 2048
END_ID = 1
QUANTUM = 8
DEPTH = 3
#: Rows that one task ranks, about.
SALT_ROWS = 50_000
#: Words in each of the two generations of a Python worker's memory, where the caller names no other number.
MEMORY = 600_000
#: Bytes of text whose words are looked up together, about; a generation holds the distinct words of as much, where they are more than its number.
TOGETHER = 4 << 20
#: New words that the library gets at once.
ASKED = 4096
#: Characters that are neither letters nor digits; an apostrophe may begin a word.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: A generation of the memory.
GENERATION = pa.struct([("word", pa.large_string()), ("ids", pa.large_list(pa.uint32()))])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of a text by the tokenizers library, asked once for each distinct word.

    The vocabulary's normaliser lower-cases, and its pre-tokenizer drops white
    space and never joins over it, so a text's ids are its words' ids one after
    another.  Texts are split, and their distinct words found and looked up, in
    Arrow; the ids of all words are then gathered by their places.  The words'
    memory has two generations: what is asked for again moves to the younger one,
    and a full younger one becomes the older.
    """

    def __init__(self, path: str, most: int = MEMORY):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = most
        self.library = Tokenizer.from_file(path)
        # texts that may hold a special token are not lower-cased here: its spelling counts
        self.special = list({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memory = self.older = pa.array([], GENERATION)

    def ask(self, words: pa.Array) -> pa.Array:
        """Words with their ids from the library: those of letters all in one text, told apart by the ids that end a word."""
        plain = pc.utf8_is_alpha(words)
        letters, rest = words.filter(plain), words.filter(pc.invert(plain))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(letters)], letters), pa.scalar(" ", pa.large_string()))[0].as_py()
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(letters):  # a letter that the normaliser takes apart
            letters, rest, ids, ends = words.slice(0, 0), words, ids[:0], ends[:0]
        alone = [e.ids for e in self.library.encode_batch_fast(rest.to_pylist(), add_special_tokens=False)]
        start = np.concatenate([[0], ends, len(ids) + np.cumsum([len(x) for x in alone], dtype=np.int64)])
        ids = np.concatenate([ids, *(np.array(x, dtype="<u4") for x in alone)])
        return pa.StructArray.from_arrays([pa.concat_arrays([letters, rest]), pa.LargeListArray.from_arrays(pa.array(start, pa.int64()), pa.array(ids))], fields=list(GENERATION))

    def learn(self, words: pa.Array) -> None:
        """Take new words into the memory."""
        at = pc.index_in(words, value_set=self.older.field("word"))
        unknown = words.filter(at.is_null())
        asked = [self.ask(unknown.slice(k, ASKED)) for k in range(0, len(unknown), ASKED)]
        self.memory = pa.concat_arrays([self.memory, self.older.take(at.drop_null()), *asked])

    def parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without the marks at their end, and these (or null): after an ASCII letter they are one word of their own to the pre-tokenizer."""
        stem = pc.ascii_rtrim(words, characters=MARKS)
        apart = pc.and_(pc.not_equal(pc.binary_length(stem), pc.binary_length(words)), pc.match_substring_regex(stem, "[a-z]$"))
        for t in self.special:
            apart = pc.and_not(apart, pc.match_substring(words, t))
        marks = pc.extract_regex(pc.if_else(apart, words, None), f"(?P<marks>[{re.escape(MARKS)}]+)$")
        return pc.if_else(apart, stem, words), marks.field("marks")

    def numbers(self, words: pa.Array) -> pa.Array:
        """The places of words in the memory, which learns the new ones (the empty word: null)."""
        at = pc.index_in(words, value_set=self.memory.field("word"))
        new = words.filter(pc.and_(at.is_null(), pc.not_equal(words, ""))).unique()  # a null word is none
        if not len(new):
            return at
        if len(self.memory) + len(new) > self.most:
            self.older, self.memory = self.memory, self.memory.slice(0, 0)
            new = words.filter(pc.not_equal(words, "")).unique()
        self.learn(new)
        return pc.index_in(words, value_set=self.memory.field("word"))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts (null: none) one after another, and where each text's end."""
        texts = texts.fill_null("")
        lower = pc.ascii_lower(texts)
        for t in self.special:
            held = pc.match_substring(texts, t)
            if pc.any(held).as_py():
                lower = pc.if_else(held, texts, lower)
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_string())
        stems, marks = self.parts(words)
        at = self.numbers(pa.concat_arrays([stems, marks]))
        both = np.arange(len(at)).reshape(2, -1).T.ravel()  # a stem's ids, then those of its marks
        lists = self.memory.field("ids").take(at.take(pa.array(both)))
        ids = pa.LargeListArray.from_arrays(lists.offsets.take(pa.array(np.arange(0, len(lists) + 1, 2))), lists.values).take(coded.indices)
        return ids.values.to_numpy(), ids.offsets.to_numpy()[split.offsets.to_numpy()[1:]]

    def ids(self, text: str) -> np.ndarray:
        return self.many(pa.array([text]))[0]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``TOGETHER`` bytes, or of one longer text."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(size) - size) // TOGETHER
    cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(texts)]
    for i, j in pairwise(cuts):
        yield texts.slice(i, j - i)


_LOADED: dict[tuple[str, int], WordIds] = {}


def cut(docs: DataFrame, path: str, window: int = WINDOW, words: int = MEMORY) -> DataFrame:
    """Pieces of at most a window: whole windows from the start, then the tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, words) not in _LOADED:
            _LOADED[path, words] = WordIds(path, words)
        library = _LOADED[path, words]
        for batch in batches:
            owners = batch.column("doc_id")
            rows, starts, lengths, sums, totals = [], [], [], [], []
            k = 0
            for texts in slices(batch.column("text")):
                ids, ends = library.many(texts)
                raw = memoryview(np.insert(ids, ends, END_ID).astype("<u4", copy=False)).cast("B")
                ends += np.arange(1, len(ends) + 1)
                for first, last in pairwise([0, *ends.tolist()]):
                    for at in range(first, last, window):
                        stop = min(at + window, last)
                        rows.append(k)
                        starts.append(at - first)
                        lengths.append(stop - at)
                        sums.append(zlib.crc32(raw[4 * at : 4 * stop]))
                        totals.append(last - first)
                    k += 1
            yield pa.RecordBatch.from_arrays(
                [owners.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), PIECES)


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing class tuples of up to ``depth`` parts that sum to ``classes``."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, parts: tuple[int, ...]) -> None:
        if not rest:
            out.append(parts)
        elif len(parts) < depth:
            for c in range(min(rest, most), 0, -1):
                if c * (depth - len(parts)) < rest:
                    break
                grow(rest - c, c, (*parts, c))

    grow(classes, classes, ())
    return out


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative x that makes |a x - b| smallest (the active-set method of Lawson and Hanson)."""
    gram, target = a.T @ a, a.T @ b
    n = a.shape[1]
    x = np.zeros(n)
    active: list[int] = []
    free = np.ones(n, dtype=bool)
    tiny = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(rounds):
        slope = target - gram[:, active] @ x[active] if active else target.copy()
        slope[~free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tiny:
            break
        active.append(best)
        free[best] = False
        while active:
            z = np.linalg.lstsq(gram[np.ix_(active, active)], target[active], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[active] = z
                break
            old = x[active]
            low = z <= 0
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[active] = old + step * (z - old)
            gone = [k for k in active if x[k] <= 1e-12]
            if not gone:
                gone = [active[int(np.argmin(z))]]
            for k in gone:
                x[k] = 0
                free[k] = True
            active = [k for k in active if k not in gone]
    return x


def plan(counts: dict[int, int], classes: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes with their repeats; together they use up ``counts`` exactly."""
    left = defaultdict(int, {c: n for c, n in counts.items() if n and c < classes})
    out = [((classes,), counts[classes])] if counts.get(classes) else []
    present = sorted(left)
    combos = [p for p in combinations(classes, depth) if len(p) > 1 and all(c in left for c in p)]
    if combos:
        row = {c: i for i, c in enumerate(present)}
        a = np.zeros((len(present), len(combos)))
        for k, p in enumerate(combos):
            for c in p:
                a[row[c], k] += 1
        x = least_squares(a, np.array([left[c] for c in present], dtype=float))
        # the most used first; a combination is never used more often than its classes allow
        for k in sorted(np.flatnonzero(x > 0).tolist(), key=lambda k: -x[k]):
            need = {c: combos[k].count(c) for c in combos[k]}
            times = min([int(np.floor(x[k] + 1e-6)), *(left[c] // m for c, m in need.items())])
            if times > 0:
                out.append((combos[k], times))
                for c, m in need.items():
                    left[c] -= m * times
    return out + greedy(left, classes)


def greedy(left: dict[int, int], classes: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest class first, a whole group of equal sequences at a time."""
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [pattern, repeats]
    for c in sorted((c for c, n in left.items() if n), reverse=True):
        n = left[c]
        while n:
            gap = min((g for g, x in open_.items() if g >= c and x), default=None)
            if gap is None:
                fits = classes // c
                if n >= fits:
                    open_[classes - fits * c].append([(c,) * fits, n // fits])
                    n %= fits
                else:
                    open_[classes - n * c].append([(c,) * n, 1])
                    n = 0
                continue
            pattern, repeats = open_[gap].pop()
            fits = min(gap // c, n)
            used = min(repeats, n // fits)
            open_[gap - fits * c].append([pattern + (c,) * fits, used])
            if repeats > used:
                open_[gap].append([pattern, repeats - used])
            n -= used * fits
    return [(tuple(p), r) for group in open_.values() for p, r in group]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first ranks, repeats, first sequence and slot of the runs that its pieces go to."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, repeats in patterns:
        for slot, c in enumerate(pattern):
            runs[c].append((used[c], sequence, slot, repeats))
            used[c] += repeats
        sequence += repeats
    return {c: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for c, r in runs.items()}


def place(cls: Column, rank: Column, found: dict[int, tuple[np.ndarray, ...]]) -> Column:
    """sequence and slot of the piece with this rank (from 0) in its class."""

    @F.pandas_udf("struct<sequence_id long, slot long>")
    def look(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        sequence, slot = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        c, r = c.to_numpy(), r.to_numpy()
        for k in np.unique(c):
            mine = c == k
            first, at, where, _ = found[int(k)]
            run = np.searchsorted(first, r[mine], side="right") - 1
            sequence[mine] = at[run] + r[mine] - first[run]
            slot[mine] = where[run]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    return look(cls, rank)


def pack(spark: SparkSession, docs: DataFrame, path: str, window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH, words: int = MEMORY) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.  ``words`` bounds what each generation of a worker's memory holds."""
    stage = Stage(spark, "packing")
    classes = -(-window // quantum)
    pieces = stage.save(cut(docs, path, window, words), "pieces")
    salts = max(1, pieces.count() // SALT_ROWS)
    cls = F.ceil(F.col("length") / quantum).cast("long")
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts))
    pieces = pieces.withColumns({"cls": cls, "salt": salt})
    groups = pieces.groupBy("cls", "salt").count()
    before = Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = stage.save(groups.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "groups")
    counts = {r["cls"]: r["n"] for r in groups.groupBy("cls").agg(F.sum("count").alias("n")).collect()}
    patterns = plan(counts, classes, depth)
    found = places(patterns)
    order = Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(groups.drop("count"), ["cls", "salt"])
    placed = ranked.withColumn("_at", place(F.col("cls"), F.col("rank") + F.col("before"), found)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.slot"
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long"))).drop("slot")

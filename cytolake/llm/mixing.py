"""Language-model scores by logistic mixing of bit predictors under gates, refined along each text.

A text is the bytes of its UTF-8, then an end mark.  Each byte is coded as eight
binary decisions.  Predictors of orders 0 to 5, and one of the bytes since the last
white space (five at most), look the decision up by these bytes and the bits
already seen: exact counts of zeros and ones over all training documents, so
what is kept grows with the corpus and no two contexts share a count.  A gate (the longest
context that has been seen, how often, and whether always with one outcome)
chooses a weight vector, and the predictors' log odds are mixed with it.  The
mixed probability is refined by a map learned per decision node, and the mean of
both is the corpus's.  Weights and map are learned from all windows of training texts:
each round adds up slopes and curvatures over all shards, a window's own occurrence
taken out of the counts that predict it, and takes a Newton step for each gate.

Two hashed contexts of unbounded length are coded beside the bytes, both adaptively:
a text is cut after words chosen by their hash, and for each piece a decision
tells first whether it is the piece that followed the same two words most often
in training (a training text's own occurrence not counted); if so, its bytes are
known.  How sure this is starts with what it was over all training texts and
rises with the pieces guessed in a row.  In the other pieces a byte is guessed
from the last place in the text with the same five bytes before; the corpus's
probability of that byte is corrected by how often such guesses, made after as
many right ones, came true in this text so far.  All of it is a proper code, so a
text's score is a log probability, and bits per byte follow from it.  It depends
on the documents only, not on how they are dealt to tasks.

Texts are dealt to blocks of a bounded size, in a written table with each block's
questions: its distinct six-byte windows go to shards by the three bytes before
the last (a shard has all windows of its contexts of order 3 to 5 and counts them by
itself), its words and pieces to ranges of their hashes.  Orders 0 to 2 have a
table with a slot for every context there can be.  Each distinct window is scored
once, in its shard.  Shards and ranges answer each block in the order in which it asked.

Beside it stands the base model: add-one unigram word counts, by 64-bit hashes of the words.

Defined cases: a null text is an empty one, which is only the end; without
training documents every byte costs eight bits; a null doc_id belongs to no
held-out fold; repeated rows are counted and scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, packed, remainder, unpacked
from .jaccard import batch_of, block_number, mix, powers, range_of, spans

ORDERS = 6
PREDICTORS = ORDERS + 1
WINDOW_BYTES = ORDERS
START, END = 0xFE, 0xFF  # neither occurs in UTF-8
#: Orders with a table of all contexts (the others are counted in shards), and log2 of its slots.
LOW = 3
TABLE_BITS = (8, 16, 24)
FOLDS, HELD_OUT = 7, 2
#: Bytes of text and texts of a block, about (one text is never cut).
BLOCK_BYTES, BLOCK_ROWS = 3_500_000, 30_000
#: Bytes of text a shard of windows, and windows of a row of the shards' table (more only for one context of order 3).
SHARD_BYTES = 8_000_000
SLICE = 60_000
#: Bytes of text a range of words, and a range of pieces.
WORD_BYTES, PIECE_BYTES = 64_000_000, 32_000_000
#: Weight of a gate's start, in events; the last steps are those that promise no more than this share of the loss.
LEARN_PRIOR, LEARN_UNTIL = 1.0, 1e-3
#: One word in so many ends a piece; words before a piece that its guess is looked up by.
CUT, BEFORE = 6, 2
#: Classes of a guess, by how often it was seen.
SEEN = 4
#: Weight of what guesses of pieces were over all texts, and the least chance of either outcome.
PIECE_PRIOR, PIECE_LEAST = 2.0, 0.003
#: Right guesses of bytes in a row from which they count, by classes; weight of the start of each class in a text.
RUNS = (4, 8, 16, 32)
BYTE_PRIOR = 4.0
#: Steps of a log probability of one, as shards tell it.
LOG_STEPS = 1024
#: Added to both counts of a predictor.
PRIOR = 0.4
GATES = ORDERS * 8
APM_BINS = 24

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


# counts in 16 bits: exact up to 63, then in steps of an eighth of a doubling, as far as a long goes
_STEPS = np.array([*range(64), *(64 * 2 ** ((q - 64) / 8) for q in range(64, 64 + 8 * 57))])


# log odds of a pair of counts, and the part of the gate that tells how many they are and whether one is none
_ODDS = np.log((_STEPS[None, :] + PRIOR) / (_STEPS[:, None] + PRIOR)).astype(np.float32)
_LEVEL = (np.minimum(3, np.log2(np.maximum(_STEPS[:, None] + _STEPS[None, :], 1)).astype(np.int64) // 2) * 2 + (np.minimum(_STEPS[:, None], _STEPS[None, :]) == 0)).astype(np.uint8)


def without_one(q: np.ndarray) -> np.ndarray:
    """Quantised counts less one (counts beyond the exact ones stay)."""
    return np.where((q > 0) & (q <= 64), q - 1, q).astype(q.dtype)


def quantised(n: np.ndarray) -> np.ndarray:
    out = np.asarray(n).astype(np.uint16)
    large = np.asarray(n) >= 64
    out[large] = np.searchsorted(_STEPS, n[large], side="right") - 1
    return out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte window that ends at each byte of the texts (their ends included), and where each text begins."""
    lead = bytes([START]) * (WINDOW_BYTES - 1)
    tail = bytes([END])
    raw = np.frombuffer(b"".join([p for t in texts for p in (lead, t, tail)] or [b""]), dtype=np.uint8)
    n = len(raw) - WINDOW_BYTES + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW_BYTES):
        key <<= np.uint64(8)
        key |= raw[k : n + k]
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # windows that end in another text's lead are none of its own
    own = raw[WINDOW_BYTES - 1 :] != START
    return key[own], begin


def counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each window: that of its context of order 3."""
    return (mix((keys >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with a space after each text, and where each text begins and ends."""
    raw = np.frombuffer(b"".join([p for t in texts for p in (t, b" ")]), dtype=np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64)) - 1
    return raw, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends


class Hashes:
    """64-bit hashes of any stretches of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


#: Hash of the end token of the base model, which no word has but by a clash.
END_WORD = mix(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, with the end token after each text, and the text of each."""
    raw, begin, ends = joined([t.lower() for t in texts])
    start, end = word_bounds(raw)
    owner = np.concatenate([np.searchsorted(ends, start), np.arange(len(texts))])
    h = np.concatenate([Hashes(raw).of(start, end), np.full(len(texts), END_WORD)])
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


@dataclass
class Pieces:
    """Pieces of texts (bytes start to end, each in one text), hashes of the words before and of themselves."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    key: np.ndarray
    own: np.ndarray


def pieces_of(texts: list[bytes]) -> Pieces:
    """A piece ends where a word chosen by its hash begins, or with the text; places are those of ``joined``."""
    raw, begin, ends = joined(texts)
    hashes = Hashes(raw)
    first, last = word_bounds(raw)
    owner = np.searchsorted(ends, first)
    place = np.arange(len(first))
    nth = place - np.searchsorted(owner, owner)
    cut = (hashes.of(first, last) % np.uint64(CUT) == 0) & (nth > 0)
    # a piece begins with its text, or at a chosen word; its key is the stretch from two words before
    back = first[np.maximum(place - BEFORE, 0)]
    back = np.where(nth >= BEFORE, back, begin[owner])
    start = np.concatenate([begin, first[cut]])
    from_ = np.concatenate([begin, back[cut]])
    own = np.concatenate([np.arange(len(texts)), owner[cut]])
    order = np.argsort(start, kind="stable")
    start, from_, own = start[order], from_[order], own[order]
    end = np.minimum(np.concatenate([start[1:], [len(raw)]]), ends[own]) if len(start) else start
    keep = end > start
    start, from_, own, end = start[keep], from_[keep], own[keep], end[keep]
    return Pieces(start, end, own, hashes.of(from_, start), hashes.of(start, end))


def piece_notes(p: Pieces, train: np.ndarray) -> np.ndarray:
    """31 bits of each piece's hash, and whether it is a training text's."""
    return (((p.own >> np.uint64(32)) & ~np.uint64(1)) | train[p.owner].astype(np.uint64)).astype("<u4")


def window_counts(at: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, ascending, with their training counts."""
    both = np.sort((at << np.uint64(1)) | taught.astype(np.uint64))
    keys = both >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else first


class Asked:
    """What a block of texts asks shards and ranges, in the order in which they answer."""

    def __init__(self, texts: list[bytes], train: list[bool], parts: tuple[int, int, int]):
        shards, word_ranges, piece_ranges = parts
        self.taught = np.array(train, dtype=bool)
        self.at, self.begin = windows(texts)
        self.sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        keys, count = window_counts(self.at, np.repeat(self.taught, self.sizes))
        shard = shard_of(keys, shards)
        order = np.argsort(shard, kind="stable")
        self.windows, self.window_counts, self.shard = keys[order], count[order], shard[order]
        self.word, self.word_owner = words_of(texts)
        self.words, self.word_at = np.unique(self.word, return_inverse=True)
        self.word_range = range_of(self.words >> np.uint64(16), word_ranges, 1 << 64)
        self.pieces = pieces_of(texts)
        key = self.pieces.key >> np.uint64(16)
        self.order = np.argsort(key, kind="stable")
        self.piece_keys, self.piece_notes = key[self.order], piece_notes(self.pieces, self.taught)[self.order]
        self.piece_range = range_of(self.piece_keys, piece_ranges, 1 << 64)

    def rows(self) -> Iterator[dict]:
        word_counts = np.bincount(self.word_at, weights=self.taught[self.word_owner], minlength=len(self.words)).astype(np.int64)
        for kind, at, keys, notes in (
            ("window", self.shard, self.windows, self.window_counts),
            ("word", self.word_range, self.words, word_counts),
            ("piece", self.piece_range, self.piece_keys, self.piece_notes),
        ):
            for f, e in zip(*cuts_of(at), strict=True):
                yield {"kind": kind, "at": int(at[f]), "keys": packed(np.diff(keys[f:e], prepend=np.uint64(0))), "notes": notes[f:e].tobytes() if kind == "piece" else packed(notes[f:e])}


def asked_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The ascending keys of each row of questions."""
    return [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in column]


def asked_counts(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([unpacked(x.as_py()).view(np.int64) for x in column])


def cuts_of(at: np.ndarray) -> tuple[list[int], list[int]]:
    """First and end of each run of equal numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
    return cuts[:-1], cuts[1:]


BLOCKS = {"block": pa.int64(), "place": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "text": pa.binary(), "size": pa.int64(), "kind": pa.string(), "at": pa.int64(), "keys": pa.binary(), "notes": pa.binary()}
BLOCKS_SCHEMA = "block long, place long, doc_id long, train boolean, text binary, size long, kind string, at long, keys binary, notes binary"


def blocks(docs: DataFrame, parts: tuple[int, int, int]) -> DataFrame:
    """Rows of two sorts: the texts in blocks (kind is text), and each block's questions to a shard or a range."""

    most_bytes, most_rows = BLOCK_BYTES, BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        texts: list[bytes] = []
        size = count = 0

        def block() -> pa.RecordBatch:
            nonlocal size, count
            number = block_number(count, 30)
            for place, (r, t) in enumerate(zip(rows, texts, strict=True)):
                r |= {"kind": "text", "place": place, "size": len(t), "text": pa.compress(t, codec="zstd", asbytes=True)}
            rows.extend(Asked(texts, [r["train"] for r in rows], parts).rows())
            for r in rows:
                r["block"] = number
            out = batch_of(BLOCKS, rows)
            rows.clear()
            texts.clear()
            size, count = 0, count + 1
            return out

        for batch in batches:
            for doc_id, train, x in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text"), strict=True):
                texts.append((x.as_py() or "").encode("utf-8", "surrogatepass"))
                rows.append({"doc_id": doc_id, "train": train})
                size += len(texts[-1])
                if size >= most_bytes or len(rows) >= most_rows:
                    yield block()
        if rows:
            yield block()

    return docs.select("doc_id", "train", "text").mapInArrow(run, BLOCKS_SCHEMA)


def sharded(found: DataFrame) -> DataFrame:
    """(shard, w, n): the windows of all blocks with the sums of their counts; a row has all windows of its contexts of order 3."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = counted(np.concatenate(asked_keys(table.column("keys"))), asked_counts(table.column("notes")))
        context = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF)
        order = np.argsort(context, kind="stable")
        keys, n, context = keys[order], n[order], context[order]
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, SLICE))])
        ends = [*cuts[1:], len(keys)]
        rows = [[packed(x[f:e]) for f, e in zip(cuts, ends, strict=True)] for x in (keys, n)]
        return pa.Table.from_arrays([pa.array([table.column("shard")[0].as_py()] * len(cuts), pa.int64()), *(pa.array(r, pa.binary()) for r in rows)], names=["shard", "w", "n"])

    return found.select(F.col("at").alias("shard"), "keys", "notes").groupBy("shard").applyInArrow(run, "shard long, w binary, n binary")


def slice_rows(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and counts of each row of ``sharded``."""
    for w, n in zip(table.column("w"), table.column("n"), strict=True):
        yield unpacked(w.as_py()), unpacked(n.as_py()).view(np.int64)


def word_order(keys: np.ndarray) -> np.ndarray:
    """Bytes of the context back to the last white space, that included (five where there is none)."""
    out = np.full(len(keys), ORDERS - 1, dtype=np.int64)
    for k in range(ORDERS - 1, 0, -1):
        byte = (keys >> np.uint64(8 * k)) & np.uint64(0xFF)
        out[(byte == 32) | (byte == 10)] = k
    return out


def high_counts(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised counts of zeros and ones of the contexts of order ``LOW`` on, exact among these windows: shape (orders, 8, windows, 2)."""
    out = np.zeros((ORDERS - LOW, 8, len(keys), 2), dtype=np.uint16)
    for order in range(LOW, ORDERS) if len(keys) else ():
        each, inverse = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        at = np.argsort(inverse, kind="stable")
        first = np.searchsorted(inverse[at], np.arange(len(each)))
        total = np.concatenate([[0], np.cumsum(np.add.reduceat(n[at], first))])
        low = np.searchsorted(each, each & ~np.uint64(0xFF))
        high = np.searchsorted(each, each | np.uint64(0xFF), side="right")
        for bit in range(8):
            left = np.uint64(8 - bit)
            middle = np.searchsorted(each, ((each >> left) << left) + np.uint64(1 << (7 - bit)))
            pair = np.stack([total[middle] - total[low], total[high] - total[middle]], axis=1)
            out[order - LOW, bit] = quantised(pair)[inverse]
            one = bits_of(each, bit) == 1
            low, high = np.where(one, middle, low), np.where(one, high, middle)
    return out


def slots(keys: np.ndarray, bit: int) -> list[np.ndarray]:
    """The slot in the table of each order below ``LOW`` for decision ``bit`` (0 first) of the keys' last byte."""
    last = keys & np.uint64(0xFF)
    node = (np.uint64(1) << np.uint64(bit)) | (last >> np.uint64(8 - bit))
    return [((((keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)) << np.uint64(8)) | node).astype(np.int64) for order in range(LOW)]


def pairs_of(table: np.ndarray, high: np.ndarray, keys: np.ndarray, words: np.ndarray, bit: int) -> np.ndarray:
    """Each predictor's quantised counts for decision ``bit``: shape (predictors, events, 2)."""
    q = np.empty((PREDICTORS, len(keys), 2), dtype=np.uint16)
    for order, s in enumerate(slots(keys, bit)):
        q[order] = table[s + OFFSETS[order]]
    q[LOW:ORDERS] = high[:, bit]
    q[ORDERS] = q[words, np.arange(len(keys))]
    return q


def bits_of(keys: np.ndarray, bit: int) -> np.ndarray:
    return ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])


def trigrams(grams: DataFrame) -> DataFrame:
    """(t, n): counts of the windows' last three bytes, added up within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for keys, n in slice_rows(batch):
                seen = n > 0
                held, total = counted(np.concatenate([held, keys[seen] & np.uint64(0xFFFFFF)]), np.concatenate([total, n[seen]]))
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(total)], names=["t", "n"])

    return grams.select("w", "n").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def low_tables(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantised counts of zeros and ones of every slot of the low orders: shape (slots, 2)."""
    out = np.zeros((OFFSETS[-1], 2), dtype=np.uint16)
    for bit in range(8) if len(found) else ():
        b = bits_of(found, bit)
        for order, s in enumerate(slots(found, bit)):
            at = np.argsort(s, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(s[at]) != 0]))
            for outcome in (0, 1):
                out[s[at][first] + OFFSETS[order], outcome] = quantised(np.add.reduceat((n * (b == outcome))[at], first))
    return out


def gathered_trigrams(stage: Stage, grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``trigrams`` of all shards in one place: an entry a sequence of three bytes at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in ("t", "n")], names=["t", "n"])

    rows = [(np.frombuffer(r["t"], dtype="<u8"), np.frombuffer(r["n"], dtype="<i8")) for r in stage.save(trigrams(grams).mapInArrow(pack, "t binary, n binary"), "tables").toLocalIterator()]
    found, n = (np.concatenate([np.zeros(0, dtype=d), *(r[i] for r in rows)]) for i, d in enumerate(("<u8", "<i8")))
    return found, n


_TABLES: list[tuple[object, np.ndarray]] = []


def _tables(held) -> np.ndarray:
    """The worker's tables of the low orders, made once from this broadcast of the trigrams."""
    if not _TABLES or _TABLES[0][0] is not held.value:
        _TABLES[:] = [(held.value, low_tables(*held.value))]
    return _TABLES[0][1]


def inputs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the predictors (with a constant last) and the gate, from quantised counts of shape (predictors, events, 2)."""
    zero, one = q[:, :, 0], q[:, :, 1]
    x = np.full((q.shape[1], PREDICTORS + 1), 0.3, dtype=np.float32)
    for o in range(PREDICTORS):
        x[:, o] = _ODDS[zero[o], one[o]]
    longest = np.zeros(q.shape[1], dtype=np.int64)
    for o in range(1, ORDERS):
        longest[(zero[o] | one[o]) > 0] = o  # a longer context that was seen implies the shorter ones
    row = np.arange(q.shape[1])
    return x, longest * 8 + _LEVEL[zero[longest, row], one[longest, row]]


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def apm_place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin below and the weight of the one above, of a mixed log odds."""
    p = (np.clip(z, -8, 8) + 8) / 16 * (APM_BINS - 1)
    low = np.minimum(p.astype(np.int64), APM_BINS - 2)
    return low, p - low


@dataclass
class Model:
    """Tables of the low orders, mixing weights per gate and the refining map per node."""

    tables: np.ndarray
    weights: np.ndarray
    apm: np.ndarray

    def log10(self, keys: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each window's last byte, given those before it; without ``high`` no longer context was seen."""
        out = np.zeros(len(keys))
        high = np.zeros((ORDERS - LOW, 8, len(keys), 2), dtype=np.uint16) if high is None else high
        words = word_order(keys)
        for bit in range(8):
            x, gate = inputs(pairs_of(self.tables, high, keys, words, bit))
            z = np.einsum("ei,ei->e", x, self.weights[gate])
            node = (1 << bit) | ((keys & np.uint64(0xFF)) >> np.uint64(8 - bit)).astype(np.int64)
            low, up = apm_place(z)
            refined = self.apm[node, low] * (1 - up) + self.apm[node, low + 1] * up
            p = np.clip((squash(z) + refined) / 2, 1e-6, 1 - 1e-6)
            out += np.log10(np.where(bits_of(keys, bit) == 1, p, 1 - p))
        return out


def start_weights() -> np.ndarray:
    w = np.full((GATES, PREDICTORS + 1), 0.2)
    w[:, -1] = 0.0
    return w


def start_apm() -> tuple[np.ndarray, np.ndarray]:
    """Ones and events of the refining map as if seen before: the map starts as the identity."""
    p = squash(np.linspace(-8, 8, APM_BINS))
    events = np.full((256, APM_BINS), 16.0)
    return events * p, events


def events(tables: np.ndarray, keys: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each decision of training windows: inputs, gates, outcomes and nodes, a window's own occurrence taken out of the counts."""
    words, row = word_order(keys), np.arange(len(keys))
    for bit in range(8):
        q, b = pairs_of(tables, high, keys, words, bit), bits_of(keys, bit)
        q[:, row, b] = without_one(q[:, row, b])
        yield *inputs(q), b, (1 << bit) | ((keys & np.uint64(0xFF)) >> np.uint64(8 - bit)).astype(np.int64)


#: Sums of a gate: its loss, slope and curvature.
GATE_SUMS = 1 + (PREDICTORS + 1) + (PREDICTORS + 1) ** 2


def gate_sums(weights: np.ndarray, x: np.ndarray, gate: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Loss (nats), its negative slope and its curvature by the weights, of each gate's events: shape (gates, ``GATE_SUMS``)."""
    out = np.zeros((GATES, GATE_SUMS))
    order = np.argsort(gate.astype(np.uint8), kind="stable")
    x, b, n = x[order].astype(np.float64), b[order], n[order]
    cuts = np.searchsorted(gate[order], np.arange(GATES + 1))
    for g in range(GATES):
        pick = slice(cuts[g], cuts[g + 1])
        if cuts[g] == cuts[g + 1]:
            continue
        p = squash(x[pick] @ weights[g])
        loss = -(n[pick] @ np.log(np.where(b[pick] == 1, p, 1 - p)))
        bend = x[pick].T @ (x[pick] * (n[pick] * p * (1 - p))[:, None])
        out[g] = np.concatenate([[loss], (n[pick] * (b[pick] - p)) @ x[pick], bend.ravel()])
    return out


def map_sums(weights: np.ndarray, x: np.ndarray, gate: np.ndarray, b: np.ndarray, node: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ones and events of each place of the refining map: shape (2, 256, bins)."""
    low, up = apm_place(np.einsum("ei,ei->e", x, weights[gate]))
    at = np.concatenate([node * APM_BINS + low, node * APM_BINS + low + 1])
    share = np.concatenate([n * (1 - up), n * up])
    return np.stack([np.bincount(at, weights=w, minlength=256 * APM_BINS) for w in (share * np.tile(b, 2), share)]).reshape(2, 256, APM_BINS)


def over_all(grams: DataFrame, held, weights: np.ndarray, refining: bool) -> np.ndarray:
    """``gate_sums`` or ``map_sums`` of all distinct training windows, each counted as often as it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for every, times in slice_rows(batch):
                keys, times = every[times > 0], times[times > 0]  # other windows add to no count
                high = high_counts(keys, times)
                for pick in (slice(i, i + 20_000) for i in range(0, len(keys), 20_000)):
                    n = times[pick].astype(float)
                    for x, gate, b, node in events(_tables(held), keys[pick], high[:, :, pick]):
                        part = map_sums(weights, x, gate, b, node, n) if refining else gate_sums(weights, x, gate, b, n)
                        total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["k", "v"])

    out = np.zeros((2, 256, APM_BINS) if refining else (GATES, GATE_SUMS))
    for r in grams.select("w", "n").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # as many rows as sums
        out.ravel()[r["k"]] = r["v"]
    return out


def learn(sums) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refining map of all training windows; ``sums(weights, refining)`` is ``over_all``.

    Each gate's weights are those of the least loss, by Newton's steps; one that doesn't lower the loss is halved.
    Weights have six places, so that the order of summation does not show.
    """
    start = start_weights()
    width = start.shape[1]
    w, trial, step = start.copy(), start.copy(), np.zeros(start.shape)
    loss, gain = np.full(GATES, np.inf), np.full(GATES, np.inf)
    while True:
        found = sums(trial, False)
        for g in range(GATES):
            now = found[g, 0] + LEARN_PRIOR / 2 * np.sum((trial[g] - start[g]) ** 2)
            if now <= loss[g]:
                w[g], loss[g] = trial[g], now
                slope = found[g, 1 : 1 + width] - LEARN_PRIOR * (w[g] - start[g])
                step[g] = np.linalg.solve(found[g, 1 + width :].reshape(width, width) + LEARN_PRIOR * np.eye(width), slope)
                gain[g] = slope @ step[g]
            else:
                step[g], gain[g] = step[g] / 2, gain[g] / 2
            trial[g] = np.round(w[g] + step[g], 6)
        if gain.sum() / 2 <= LEARN_UNTIL * loss.sum():
            break
    ones, seen = start_apm()
    more = sums(trial, True)
    return trial, np.round((ones + more[0]) / (seen + more[1]), 9)


ANSWERS = "block long, kind string, at long, answer binary, n long, v long"


def answers(rows: list[tuple]) -> pa.Table:
    types = {"block": pa.int64(), "kind": pa.string(), "at": pa.int64(), "answer": pa.binary(), "n": pa.int64(), "v": pa.int64()}
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


def stepped(logs: np.ndarray) -> np.ndarray:
    """Log probabilities in steps of 1 / ``LOG_STEPS``, rounded down, so that probabilities add up to one at most."""
    return np.minimum(np.ceil(logs * -LOG_STEPS), 0xFFFF).astype("<u2")


def window_answers(asked: DataFrame, grams: DataFrame, held, weights: np.ndarray, apm: np.ndarray) -> DataFrame:
    """Log probabilities (in steps) of each block's windows, from their shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model(_tables(held), weights, apm)
        keys, logs = [], []
        for k, n in slice_rows(right):
            high = high_counts(k, n)
            keys.append(k)
            logs += [model.log10(k[i : i + 20_000], high[:, :, i : i + 20_000]) for i in range(0, len(k), 20_000)]
        keys, logs = np.concatenate(keys), stepped(np.concatenate(logs))
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        own = asked_keys(left.column("keys"))
        return answers([(b, "window", at, logs[np.searchsorted(keys, w)].tobytes(), None, None) for b, at, w in zip(left.column("block").to_pylist(), left.column("shard").to_pylist(), own, strict=True)])

    return asked.select("block", F.col("at").alias("shard"), "keys").groupBy("shard").cogroup(grams.groupBy("shard")).applyInArrow(run, ANSWERS)


def word_answers(asked: DataFrame) -> DataFrame:
    """Training counts of each block's words, and of each range the training tokens (n) and words (v)."""

    def run(table: pa.Table) -> pa.Table:
        keys = asked_keys(table.column("keys"))
        n = asked_counts(table.column("notes"))
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(words)).astype(np.int64)
        at = table.column("at")[0].as_py()
        each = [(b, "word", at, packed(total[inverse[lo:hi]]), None, None) for b, lo, hi in zip(table.column("block").to_pylist(), *spans(row, len(keys)), strict=True)]
        return answers([*each, (None, "word", at, None, int(n.sum()), int(np.count_nonzero(total)))])

    return asked.select("block", "at", "keys", "notes").groupBy("at").applyInArrow(run, ANSWERS)


def guesses(key: np.ndarray, own: np.ndarray, train: np.ndarray) -> np.ndarray:
    """For each piece 0 (no guess), or 1 + 2 * class of the guess's count + whether it is right.

    A guess is the piece that followed the key most often in training (of
    ties, that of the lowest hash).  The counts are without the piece itself,
    if it is a training text's; it is then right only if it is still ahead of all others.
    """
    order = np.lexsort((own, key))
    k, x, t = key[order], own[order], train[order].astype(np.int64)
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    first = np.flatnonzero(new_key | np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.add.reduceat(t, first)
    sub = np.cumsum(np.bincount(first, minlength=len(k))) - 1
    groups = np.flatnonzero(new_key[first])
    group = np.cumsum(np.bincount(groups, minlength=len(first))) - 1
    most = np.maximum.reduceat(count, groups)
    best = np.flatnonzero(count == most[group])
    top = best[np.searchsorted(group[best], np.arange(len(groups)))]
    rest = count.copy()
    rest[top] = 0
    second = np.maximum.reduceat(rest, groups)
    mine, g = count[sub] - t, group[sub]
    is_top = top[g] == sub
    right = is_top & (mine > 0) & ((t == 0) | (mine > second[g]))
    seen = np.where(is_top, np.maximum(mine, second[g]), most[g])
    level = np.minimum(SEEN - 1, np.log2(np.maximum(seen, 1)).astype(np.int64))
    out = np.empty(len(k), dtype=np.uint8)
    out[order] = np.where(seen > 0, 1 + 2 * level + right, 0)
    return out


def piece_answers(asked: DataFrame) -> DataFrame:
    """``guesses`` of each block's pieces, and of each class those made for training texts (n) and the right ones (v)."""

    def run(table: pa.Table) -> pa.Table:
        keys = asked_keys(table.column("keys"))
        notes = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("notes")])
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        train = (notes & 1).astype(bool)
        found = guesses(np.concatenate(keys), notes >> 1, train)
        made = np.bincount(found[train], minlength=2 * SEEN + 1)[1:].reshape(SEEN, 2)
        each = [(b, "piece", table.column("at")[0].as_py(), found[lo:hi].tobytes(), None, None) for b, lo, hi in zip(table.column("block").to_pylist(), *spans(row, len(keys)), strict=True)]
        return answers(each + [(None, "piece", c, None, int(m.sum()), int(m[1])) for c, m in enumerate(made)])

    return asked.select("block", "at", "keys", "notes").groupBy("at").applyInArrow(run, ANSWERS)


def looked_up(at: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The log probability of each window in ``at``; all are in ``keys`` (ascending).

    A table addressed by a hash holds most keys beside their values; the others are searched.
    """
    bits = max(8, int(len(keys)).bit_length() + 2)
    shift, odd = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
    table = np.full((1 << bits, 2), np.iinfo(np.uint64).max, dtype=np.uint64)
    place = ((keys * odd) >> shift).view(np.int64)
    table[place, 0], table[place, 1] = keys, logs.view(np.uint64)
    found = table.take(((at * odd) >> shift).view(np.int64), axis=0)
    out = found[:, 1].view(np.float64).copy()
    miss = np.flatnonzero(found[:, 0] != at)
    out[miss] = logs[np.searchsorted(keys, at[miss])]
    return out


def last_alike(at: np.ndarray, begin_of: np.ndarray) -> np.ndarray:
    """The last place before each one, in its text, with the same five bytes before it (-1: none)."""
    n = len(at)
    context = at >> np.uint64(8)
    if n <= 1 << 24:
        both = np.sort((context << np.uint64(24)) | np.arange(n, dtype=np.uint64))
        place, context = (both & np.uint64((1 << 24) - 1)).astype(np.int32), both >> np.uint64(24)
    else:
        place = np.argsort(context, kind="stable")
        context = context[place]
    out = np.full(n, -1, dtype=np.int32)
    here, there = place[1:], place[:-1]
    same = (context[1:] == context[:-1]) & (there >= begin_of[here])
    out[here[same]] = there[same]
    return out


def in_a_row(right: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many places just before each one are right, from ``first`` of its text on."""
    place = np.arange(len(right), dtype=np.int32)
    wrong = np.maximum.accumulate(np.where(right, np.int32(-1), place)) if len(right) else place
    before = np.concatenate([np.array([-1], dtype=np.int32), wrong[:-1]]) if len(right) else place
    return place - np.maximum(before + 1, first)


def log_odds(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def refined(logs: np.ndarray, at: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes' log probabilities, with guesses from the text itself corrected by how often they came true."""
    begin_of = np.repeat(begin.astype(np.int32), sizes)  # a block has a few millions of places
    last = last_alike(at, begin_of)
    right = (last >= 0) & (at == at[np.maximum(last, 0)])
    run = in_a_row(right, begin_of)
    out = logs.copy()
    picked = np.flatnonzero((last >= 0) & (run >= RUNS[0]))
    level = np.searchsorted(RUNS, run[picked], side="right") - 1
    for c in range(len(RUNS)):
        here = picked[level == c]
        if not len(here):
            continue
        text, hit = begin_of[here], right[here].astype(float)
        p = np.clip(10.0 ** logs[last[here]], 1e-6, 1 - 1e-6)
        start = np.searchsorted(text, text)
        n = np.arange(len(here)) - start
        hits, told = np.cumsum(hit) - hit, np.cumsum(p) - p
        hits, told = hits - hits[start], told - told[start]
        actual = (hits + BYTE_PRIOR / 2) / (n + BYTE_PRIOR)
        expected = np.clip((told + BYTE_PRIOR / 2) / (n + BYTE_PRIOR), 1e-6, 1 - 1e-6)
        q = np.clip(squash(log_odds(p) + log_odds(actual) - log_odds(expected)), 1e-6, 1 - 1e-6)
        out[here] = np.where(hit > 0, np.log10(q), logs[here] + np.log10((1 - q) / (1 - p)))
    return out


def text_scores(asked: Asked, logs: np.ndarray, found: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """log10 probability of each text, given those of its bytes and the guesses of its pieces."""
    p = asked.pieces
    total = refined(logs, asked.at, asked.begin, asked.sizes)
    made, right = found > 0, (found > 0) & (found % 2 == 0)
    run = in_a_row(right, np.searchsorted(p.owner, p.owner))
    rate = rates[np.where(made, (found.astype(np.int64) - 1) // 2, 0)]
    chance = np.clip((PIECE_PRIOR * rate + run) / (PIECE_PRIOR + run), PIECE_LEAST, 1 - PIECE_LEAST)
    told = np.where(made, np.log10(np.where(right, chance, 1 - chance)), 0.0)
    edge = np.zeros(len(total) + 1, dtype=np.int8)
    edge[p.start[right]] += 1
    np.subtract.at(edge, p.end[right], 1)
    total[np.cumsum(edge[:-1], dtype=np.int8) > 0] = 0.0
    return np.add.reduceat(total, asked.begin) + np.bincount(p.owner, weights=told, minlength=len(asked.sizes))


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, word_logs double, score double, n_bytes long"


def scored(texts: DataFrame, found: DataFrame, parts: tuple[int, int, int], rates: np.ndarray) -> DataFrame:
    """A row a document, from its block's texts and the answers to its block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _TABLES.clear()  # a worker that answered for shards before needs them no more
        left = left.sort_by("place")
        sizes = left.column("size").to_pylist()
        raw = [pa.decompress(t, decompressed_size=n, codec="zstd", asbytes=True) for t, n in zip(left.column("text").to_pylist(), sizes, strict=True)]
        asked = Asked(raw, left.column("train").to_pylist(), parts)
        got: dict[str, list[tuple[int, bytes]]] = {"window": [], "word": [], "piece": []}
        for kind, at, x in zip(right.column("kind").to_pylist(), right.column("at").to_pylist(), right.column("answer").to_pylist(), strict=True):
            got[kind].append((at, x))
        window, word, piece = ([x for _, x in sorted(got[k])] for k in ("window", "word", "piece"))
        logs = np.frombuffer(b"".join(window), "<u2") / -LOG_STEPS
        count = np.concatenate([np.zeros(0, np.int64), *(unpacked(x).view(np.int64) for x in word)])
        made = np.empty(len(asked.order), dtype=np.uint8)
        made[asked.order] = np.frombuffer(b"".join(piece), np.uint8)
        order = np.argsort(asked.windows)
        logs = looked_up(asked.at, asked.windows[order], logs[order])
        own = count[asked.word_at]
        m = len(raw)
        tally = lambda x: np.bincount(asked.word_owner, weights=x, minlength=m)
        columns = [
            left.column("doc_id"),
            left.column("train"),
            pa.array(tally(np.ones(len(own))).astype(np.int64)),
            pa.array(tally(own > 0).astype(np.int64)),
            pa.array(tally(np.log10(own + 1.0))),
            pa.array(text_scores(asked, logs, made, rates)),
            pa.array(sizes, pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=["doc_id", "train", "n_tokens", "n_known", "word_logs", "score", "n_bytes"])

    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, SCORED)


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    stage = Stage(spark, "mixing")
    fold = remainder(F.col("doc_id"), FOLDS)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", F.coalesce(fold != HELD_OUT, F.lit(True)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = tuple(max(1, -(-size // each)) for each in (SHARD_BYTES, WORD_BYTES, PIECE_BYTES))
    dealt = stage.save(blocks(keyed, parts), "blocks", "kind")
    asked = {k: dealt.filter(F.col("kind") == k) for k in ("window", "word", "piece")}
    # each step's questions and shuffle files go before the next one's come
    told = []
    for kind, answer in (("word", word_answers), ("piece", piece_answers)):
        told.append(stage.save(answer(asked[kind]), f"{kind}s"))
        stage.drop(f"blocks/kind={kind}")
        stage.settle()
    grams = stage.save(sharded(asked["window"]), "shards")
    stage.settle()
    low = gathered_trigrams(stage, grams)
    held = spark.sparkContext.broadcast(low)
    weights, apm = learn(lambda w, refining: over_all(grams, held, w, refining))
    told.append(stage.save(window_answers(asked["window"], grams, held, weights, apm), "windows"))
    for done in ("blocks/kind=window", "shards", "tables"):
        stage.drop(done)
    stage.settle()
    found = told[0].union(told[1]).union(told[2])
    totals = found.filter("block IS NULL").groupBy("kind", F.when(F.col("kind") == "piece", F.col("at")).alias("at")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = next(((r["n"], r["v"]) for r in totals if r["kind"] == "word"), (0, 0))
    rates = np.full(SEEN, 0.5)
    for r in totals:
        if r["kind"] == "piece":
            rates[r["at"]] = (r["v"] + 0.5) / (r["n"] + 1.0)
    texts = dealt.filter("kind = 'text'").select("block", "place", "doc_id", "train", "text", "size")
    rows = stage.only(scored(texts, found.filter("block IS NOT NULL").select("block", "kind", "at", "answer"), parts, rates), "documents")
    base = F.col("word_logs") - F.col("n_tokens") * float(np.log10(n + v + 1.0))
    bits = -F.col("score") / float(np.log10(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return rows.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte")
    )

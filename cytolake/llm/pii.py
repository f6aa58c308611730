"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns over the whole text.  The field's nodes are
the words that hold a digit or ``@``; its labels are ``none`` and the four
kinds.  A word in a base span has that label as an observation.  Neighbouring
words are linked in a chain, and words with the same key (their letters and
digits) are linked by skip edges from one occurrence to the next, so a value
that is found in one place is recognised in another that no pattern fits.
Loopy message passing gives each word's belief; words believed to be of a kind
become further spans, next to the base ones, which always stay.

The weights are trained by pseudo-likelihood (each word's label given its shape
and the labels of its neighbours) on the base labels of all documents; the
training data is the table of counts of distinct (shape, neighbour labels,
label) rows, whose size the shape's buckets bound.

Defined cases: a null text is an empty one and has no spans; a word may be as
long as the text (every scan is linear); ties between kinds go to the earlier
of the list; repeated rows are searched each by itself; other columns are
passed through by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ANY = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# from the start of a run of digits only: a later start in the run cannot do better
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPACES = frozenset(" \t\n\x0b\x0c\r")
WORD_END = re.compile(r"[\x20\x09-\x0D]")
NOT_DIGIT = re.compile("[^0-9]")
NOT_KEY = re.compile("[^0-9a-z@]")

#: A word joins a kind if its belief is at least this.
BELIEF = 0.6
#: Messages have settled when none changes by more; from this round on each is averaged with the one before.
SETTLED, DAMPED = 1e-6, 32
#: Words over skip edges with one label that a training row tells apart.
OVER_MOST = 3
#: Shortest key that links words by a skip edge.
SHORTEST_KEY = 6
Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' matches that hold, by start and kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidate_words(text: str) -> list[tuple[int, int]]:
    """Start and end of the words that hold a digit or ``@``."""
    out = []
    end = 0
    for m in ANY.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] not in SPACES:
            start -= 1
        stop = WORD_END.search(text, at)
        end = stop.start() if stop else len(text)
        out.append((start, end))
    return out


def bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def shape(word: str) -> tuple[int, ...]:
    """The word's buckets: digits, dots, hyphens, letters, and whether it has @, a plus, brackets, an equals sign or a colon."""
    digits = sum(map(word.count, "0123456789"))
    letters = sum(map(str.isalpha, word)) if len(word) < 200 else len(word) - digits
    return (
        bucket(digits, (1, 2, 4, 7, 9, 12, 16, 17, 20)),
        bucket(word.count("."), (1, 2, 3, 4)),
        bucket(word.count("-"), (1, 2, 4)),
        bucket(letters, (1, 4, 9)),
        int("@" in word),
        int(word[:1] == "+"),
        int("(" in word or ")" in word),
        int("=" in word or ":" in word or "/" in word),
    )


SHAPE_SIZES = (10, 5, 4, 4, 2, 2, 2, 2)
OFFSETS = np.concatenate([[0], np.cumsum(SHAPE_SIZES)])[:-1]
#: Whole shapes are hashed to this many more features.
SHAPES = 512
N_NODE = int(sum(SHAPE_SIZES)) + SHAPES


def node_features(s: tuple[int, ...]) -> np.ndarray:
    whole = 0
    for v, size in zip(s, SHAPE_SIZES, strict=True):
        whole = whole * size + v
    return np.array([*(OFFSETS + np.array(s)), int(sum(SHAPE_SIZES)) + whole * 2654435761 % (1 << 32) % SHAPES])


class Graph:
    """A text's candidate words with their observed labels and links."""

    def __init__(self, text: str, spans: list[Span]):
        self.words = candidate_words(text)
        n = len(self.words)
        self.label = [0] * n
        at = 0
        for k, (start, end) in enumerate(self.words):
            while at < len(spans) and spans[at][2] <= start:
                at += 1
            for s in spans[at:]:
                if s[0] >= end:
                    break
                if s[2] > start:
                    self.label[k] = s[1] + 1
                    break
        self.shapes = [shape(text[a:b]) for a, b in self.words]
        # neighbours in the text: nothing but one white-space character between
        self.chain = [(k, k + 1) for k in range(n - 1) if self.words[k + 1][0] - self.words[k][1] == 1]
        # all words with one key are linked with one of them: the first with an observed label, or else the first
        alike: dict[str, list[int]] = {}
        for k, (a, b) in enumerate(self.words):
            key = skip_key(text[a:b])
            if len(key) >= SHORTEST_KEY:
                alike.setdefault(key, []).append(k)
        self.skip = []
        for ks in alike.values():
            centre = next((k for k in ks if self.label[k]), ks[0])
            self.skip += [(min(centre, k), max(centre, k)) for k in ks if k != centre]
        self.skip.sort()


def skip_key(word: str) -> str:
    """What similar words share: their digits if these are many, else their letters and digits."""
    digits = NOT_DIGIT.sub("", word)
    return digits if len(digits) >= SHORTEST_KEY else NOT_KEY.sub("", word.lower())


def training_rows(docs: DataFrame) -> DataFrame:
    """Distinct (shape, labels before, after and over skip edges, label) of all documents' candidate words, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column("text"):
                text = x.as_py() or ""
                if not ANY.search(text):
                    continue
                g = Graph(text, base_spans(text))
                n = len(g.words)
                before, after, over = [-1] * n, [-1] * n, [[] for _ in range(n)]
                for i, j in g.chain:
                    after[i], before[j] = g.label[j], g.label[i]
                for i, j in g.skip:
                    over[i].append(g.label[j])
                    over[j].append(g.label[i])
                for k in range(n):
                    seen["|".join([",".join(map(str, g.shapes[k])), str(before[k]), str(after[k]), ",".join(str(x) for x, m in sorted(Counter(over[k]).items()) for _ in range(min(m, OVER_MOST))), str(g.label[k])])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["row", "n"])

    return docs.select("text").mapInArrow(lean(run), "row string, n long").groupBy("row").agg(F.sum("n").alias("n"))


class Weights:
    """Log potentials: node features by label, chain and skip edges by label pair."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip


def fit(rows: list[tuple[str, int]], rounds: int = 300, penalty: float = 1.0) -> Weights:
    """Pseudo-likelihood weights from the counted rows."""
    k = len(LABELS)
    node, chain, skip = np.zeros((N_NODE, k)), np.zeros((k, k)), np.zeros((k, k))
    if not rows:
        node[:, 0] = 1.0
        return Weights(node, chain, skip)
    rows = sorted(rows)
    feats, before, after, over, y, n = [], [], [], np.zeros((len(rows), k)), [], []
    for r, (row, count) in enumerate(rows):
        s, b, a, o, label = row.split("|")
        feats.append(node_features(tuple(map(int, s.split(",")))))
        before.append(int(b))
        after.append(int(a))
        for x in o.split(",") if o else ():
            over[r, int(x)] += 1
        y.append(int(label))
        n.append(count)
    feats, before, after, y, n = np.array(feats), np.array(before), np.array(after), np.array(y), np.array(n, dtype=float)
    one_b, one_a = np.eye(k + 1)[before][:, :k], np.eye(k + 1)[after][:, :k]
    target = np.eye(k)[y]
    weight = (n / n.sum())[:, None]
    decay = penalty / n.sum()
    params = [node, chain, skip]
    old = [p.copy() for p in params]
    step = 1.0 / (0.5 * (feats.shape[1] + 4 + over.sum(axis=1).max(initial=0)))
    for t in range(rounds):
        m = t / (t + 3)
        look = [p + m * (p - q) for p, q in zip(params, old, strict=True)]
        z = look[0][feats].sum(axis=1) + one_b @ look[1] + one_a @ look[1].T + over @ look[2]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        e = weight * (p / p.sum(axis=1, keepdims=True) - target)
        g_node = np.zeros_like(node)
        for c in range(feats.shape[1]):
            np.add.at(g_node, feats[:, c], e)
        g_skip = over.T @ e
        slope = [g_node, one_b.T @ e + (one_a.T @ e).T, (g_skip + g_skip.T) / 2]
        old, params = params, [q - 4 * step * (g + decay * q) for q, g in zip(look, slope, strict=True)]
    return Weights(*params)


def beliefs(g: Graph, w: Weights) -> np.ndarray:
    """Each word's belief in each label after loopy message passing; observed labels stay fixed.

    Messages are passed until they settle.  On a tree that takes as many
    rounds as its longest path has edges; on loops, later rounds are damped. The
    number of rounds is bounded by the size of the graph.
    """
    k = len(LABELS)
    unary = np.array([w.node[node_features(s)].sum(axis=0) for s in g.shapes])
    for i, label in enumerate(g.label):
        if label:
            unary[i] = -1e3
            unary[i, label] = 0
    unary -= unary.max(axis=1, keepdims=True)
    pairs = [(i, j, w.chain) for i, j in g.chain] + [(i, j, w.skip) for i, j in g.skip]
    if pairs:
        source = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        to = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        table = np.exp(np.array([p[2] for p in pairs] + [p[2].T for p in pairs]))
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(source), k))
        for turn in range(2 * len(pairs) + 4 * DAMPED):
            total = unary.copy()
            np.add.at(total, to, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, table) + 1e-300)
            new = new - new.max(axis=1, keepdims=True)
            if turn >= DAMPED + len(pairs):
                new = (new + message) / 2
            change = np.abs(new - message).max()
            message = new
            if change <= SETTLED:
                break
        total = unary.copy()
        np.add.at(total, to, message)
        unary = total - total.max(axis=1, keepdims=True)
    p = np.exp(unary)
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], w: Weights) -> list[Span]:
    """Spans that the field adds: words of no base span believed to be of a kind, neighbours of one kind joined."""
    g = Graph(text, base)
    if all(g.label):
        return []
    p = beliefs(g, w)
    linked = {j for _, j in g.chain}
    out: list[Span] = []
    joins = False
    for k, (a, b) in enumerate(g.words):
        best = int(np.argmax(p[k]))
        if g.label[k] or not best or p[k, best] < BELIEF:
            joins = False
            continue
        while a < b and not text[a].isalnum() and text[a] not in "+(":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a == b:
            joins = False
            continue
        if joins and k in linked and out[-1][1] == best - 1 and best - 1 >= 2:
            out[-1] = (out[-1][0], best - 1, b)
        else:
            out.append((a, best - 1, b))
        joins = True
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def train(docs: DataFrame) -> Weights:
    return fit([(r["row"], r["n"]) for r in training_rows(docs).collect()])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, w: Weights) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [[] for _ in KINDS], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base: list[Span] = []
                more: list[Span] = []
                if ANY.search(text):
                    base = base_spans(text)
                    more = added_spans(text, base, w)
                kinds = Counter(s[1] for s in base)
                for k in range(len(KINDS)):
                    counts[k].append(kinds[k])
                sha.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced by their kinds; of overlapping ones the first, then the longest, counts."""
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2])):
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, w: Weights) -> DataFrame:
    """``docs`` with every span of its texts replaced; the columns stay as they are (a null text stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            new = []
            for x in batch.column(place):
                text = x.as_py()
                if text and ANY.search(text):
                    base = base_spans(text)
                    text = redacted(text, base + added_spans(text, base, w))
                new.append(text)
            columns = list(batch.columns)
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)

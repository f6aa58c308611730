"""SentencePiece encoding and decoding for merge-type vocabularies.

A chunk of text is encoded by an agenda of adjacent symbol pairs: the pair whose
joined piece has the highest score is merged first, the leftmost of equals, until
no pair joins to a piece of the vocabulary; what has no piece becomes its UTF-8
bytes.  A chunk is a run of U+2581 with the run of letters, or of other
characters, that follows it (letters are those that the vocabulary's pieces of
more than one character have).  No merge crosses from one chunk to the next, as no
piece has two neighbouring characters of which one ends a chunk and the other
begins one; this is tested on the vocabulary, and where it holds only for U+2581,
chunks reach up to the next of these.  So chunks don't influence each other and
the ids of a chunk are remembered (a bounded memory).

Every chunk is compared with the sentencepiece library, ids and decoded text,
when a worker first meets it, so every text is covered (a filter tells what has been
compared; of a million chunks it takes about one in two hundred for compared that
hasn't been); texts that probe the model's treatment of spaces and characters are when
it is loaded, and every ``check_every``-th text of each Arrow batch as a whole.  A
difference is an error.

Defined cases: a null text is an empty one, which has only the begin and end
ids; repeated rows are encoded each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from operator import concat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Whether an array of C integers is one of little-endian unsigned 32-bit ones.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Chunks that a Python worker remembers in its newer memory; when that is full it becomes the older one.
MEMORY = 250_000
#: New chunks that are compared with the library at once.
FRESH = 20_000
#: Bits of the filter of chunks that have been compared.
FILTER_BITS = 1 << 25
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Pieces, scores and byte ids of a model, and the encoder over them."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space mark after another character; chunks would not be independent")
        joined = [p.lstrip(SPACE) for p in self.ids if len(p) > 1]
        self.letters = {c for p in joined for c in p if c.isalpha()}
        self.chunk = CHUNK
        if self.letters and not any(0 < sum(c in self.letters for c in p) < len(p) for p in joined):
            some = "".join(map(re.escape, sorted(self.letters)))
            self.chunk = re.compile(f"{SPACE}*[{some}]+|{SPACE}*[^{SPACE}{some}]+|{SPACE}+")
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.surface = [b"" if lib.is_control(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fresh: list[tuple[str, list[int]]] = []
        self.compared = bytearray(FILTER_BITS // 8)
        self.lead_ids = {c: [self.ids[s] for s in self.merge(SPACE + c)] for c in ",a"}
        self.mark = np.array([self.begin], dtype="<u4").tobytes(), np.array([self.end], dtype="<u4").tobytes()
        # spaces at the ends and in a row, other white space, marks that a normaliser would join, a space mark of the text itself
        for text in ("", " ", "a", " a", "a  b ", "a\tb\nc", "e\u0301 \u00e9 \ufb01 \u3000", f"a{SPACE}b {SPACE}", "\x00\u200b", "a,b. c1d_e\u0301f\u00b2g", ",a ,,a"):
            ids = self.encode(text)
            self.check(text, ids, self.decode(ids))

    def merge(self, chunk: str) -> list[str]:
        """The chunk's symbols after all merges."""
        symbols: list[str] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        agenda = [r * n + i for i, r in enumerate(map(rank, map(concat, chunk, chunk[1:]))) if r is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i = divmod(pop(agenda), n)
            if not symbols[i] or (j := after[i]) >= n or rank(joined := symbols[i] + symbols[j]) != r:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    push(agenda, r * n + i)
            if (k := before[i]) >= 0 and (r := rank(symbols[k] + joined)) is not None:
                push(agenda, r * n + k)
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            out: list[int] = []
            for s in self.merge(chunk):
                i = self.ids.get(s)
                if i is None:
                    out += [self.byte_ids[b] for b in s.encode()]
                else:
                    out.append(i)
            if self.is_new(chunk):
                self.fresh.append(self.in_text(chunk, out))
                if len(self.fresh) >= FRESH:
                    self.check_fresh()
            found = array("I", out).tobytes() if LITTLE else np.array(out, dtype="<u4").tobytes()
        if len(self.memory) >= MEMORY:
            self.older, self.memory = self.memory, {}
        if len(chunk) < 64:
            self.memory[chunk] = found
        return found

    def in_text(self, chunk: str, ids: list[int]) -> tuple[str, list[int]]:
        """A text that has the chunk, and its ids: the library puts one space mark before a text, as most chunks have it; others follow a character of the other kind."""
        if chunk[0] == SPACE and len(chunk) > 1:
            return chunk[1:].replace(SPACE, " "), ids
        lead = "," if chunk[0] in self.letters else "a"
        return lead + chunk.replace(SPACE, " "), self.lead_ids[lead] + ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, with begin and end."""
        known, new = self.memory.get, self.encode_chunk
        chunks = self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []
        body = [known(c) or new(c) for c in chunks]
        return b"".join([self.mark[0], *body, self.mark[1]])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text: the surfaces joined, without the space that encoding put first."""
        surface = self.surface
        raw = b"".join(map(surface.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw[1:] if raw[:1] == b" " else raw

    def is_new(self, chunk: str) -> bool:
        """Whether the filter hasn't met this chunk; it has then."""
        h, seen, new = hash(chunk), self.compared, False
        for at in (h & FILTER_BITS - 1, (h >> 25) & FILTER_BITS - 1):
            byte, bit = at >> 3, 1 << (at & 7)
            if not seen[byte] & bit:
                seen[byte] |= bit
                new = True
        return new

    def check_fresh(self) -> None:
        """Compare the chunks met since the last call with the library, all at once."""
        texts, ids = [t for t, _ in self.fresh], [i for _, i in self.fresh]
        self.fresh.clear()
        if texts:
            for text, mine, told, back in zip(texts, ids, self.library.encode(texts, num_threads=1), self.library.decode(ids, num_threads=1), strict=True):
                if mine != told or text != back:
                    raise ValueError(f"ids or text differ from the library's on {text[:80]!r}")

    def check(self, text: str, ids: bytes, decoded: bytes) -> None:
        told = self.library.encode(text, add_bos=True, add_eos=True)
        mine = np.frombuffer(ids, dtype="<u4").tolist()
        if told != mine or self.library.decode(mine).encode() != decoded:
            raise ValueError(f"ids or text differ from the library's on a text that begins {text[:80]!r}")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def encode_decode(docs: DataFrame, model: str, check_every: int = 16) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = batch.column("text")
            counts, ids_sha, text_sha = [], [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                ids = v.encode(text)
                decoded = v.decode(ids)
                if k % check_every == 0:
                    v.check(text, ids, decoded)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
            v.check_fresh()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

"""Operators against brute-force versions, exact round trips or held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cytolake.llm import common, fingerprints, jaccard, mixing, oracle, packing, passages, pieces, pii, quality, queries, toxicity, urls
from cytolake.llm.queries import tokenizer

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(name, same):
    same(queries.QUERIES[name], oracle.ORACLE[name])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")


# 1


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_as_the_patterns_say():
    rng = random.Random(3)
    for alphabet in ("0123456789 -", "0129.. ", "a@.-b+_ ", "+0123456789 ().-", "+1@a.0 -\n"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t)


def test_pii_query(spark, sf_dir, docs):
    got = queries.op1_skip_chain_pii(spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        base = plain_spans(t)
        text = pii.spans_text(base)
        row = got.loc[i]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        assert set(text.split(",")) <= set(row.spans.split(",")) or not text


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(5)
    w = pii.Weights(rng.normal(size=(pii.N_NODE, 5)), rng.normal(size=(5, 5)), np.zeros((5, 5)))
    g = pii.Graph("a1 b22 c333 d4444", [])
    g.label[1] = 2
    got = pii.beliefs(g, w)
    total = np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        if labels[1] != 2:
            continue
        s = sum(w.node[pii.node_features(g.shapes[k])].sum(axis=0)[labels[k]] for k in (0, 2, 3)) + sum(w.chain[labels[k], labels[k + 1]] for k in range(3))
        for k in range(4):
            total[k, labels[k]] += np.exp(s)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_message_passing_is_exact_on_a_tree_with_skip_edges():
    rng = np.random.default_rng(7)
    skip = rng.normal(size=(5, 5))
    w = pii.Weights(rng.normal(size=(pii.N_NODE, 5)), np.zeros((5, 5)), (skip + skip.T) / 2)
    # nothing but white space of two characters lies between, so there are skip edges only
    g = pii.Graph("555-2485  0a1  555.2485  x2y3  5552485  (555)2485", [(0, 3, 8)])
    assert g.label[0] == 4 and not g.chain and g.skip == [(0, 2), (0, 4), (0, 5)]
    n = len(g.words)
    total = np.zeros((n, 5))
    unary = [w.node[pii.node_features(s)].sum(axis=0) for s in g.shapes]
    for labels in np.ndindex(*[5] * n):
        if labels[0] == 4:
            p = np.exp(sum(unary[k][labels[k]] for k in range(1, n)) + sum(w.skip[labels[i], labels[j]] for i, j in g.skip))
            for k in range(n):
                total[k, labels[k]] += p
    assert np.allclose(pii.beliefs(g, w), total / total.sum(axis=1, keepdims=True), atol=1e-5)


def test_a_label_reaches_every_copy():
    w = pii.Weights(np.zeros((pii.N_NODE, 5)), np.zeros((5, 5)), 4 * np.eye(5))
    g = pii.Graph("+15555552485" + "  1555 555 2485  15555552485" * 20, [(0, 3, 12)])
    far = [k for k, (a, b) in enumerate(g.words) if b - a == 11]
    p = pii.beliefs(g, w)
    assert len(far) == 20 and (p[far, 4] > 0.9).all() and np.allclose(p[far], p[far[0]])


def test_repeated_value_is_found_by_its_copy(spark):
    card = "4111111111111111"
    rows = [(i, f"pay {card} now and 4012888888881881 then x{i} 12 of 300 items in 2024") for i in range(40)] + [(99, f"pay {card} today. later 4111-1111 1111x{card} again {card}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    clean = pii.redact(d, pii.train(d)).filter("doc_id = 99").first().text
    assert card not in clean.replace("x" + card, "") and "[CARD]" in clean


# 2


def test_passages_against_brute_force(spark, docs):
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)]
    got = {r.doc_id: r for r in passages.marked(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in sorted(rows):
        us = passages.units(t)
        cut = []
        for k, (a, b, u) in enumerate(us):
            if len(u.split()) >= passages.LEAST and first.setdefault(u, (i, k)) != (i, k):
                cut.append((a, b))
        assert got[i].removed == ",".join(f"{a}:{b}" for a, b in cut) and got[i].n_units == len(us)
        assert got[i].clean_text == passages.without(t, cut)


def test_passage_in_the_middle_of_a_line_is_removed(spark):
    passage = " ".join(f"Sentence number {k} of the passage goes here." for k in range(10))
    rows = [(1, f"Alpha beta gamma delta one. {passage} The end of one is here."), (2, f"Another start of words here. {passage} A different end comes now.")]
    got = {r.doc_id: r.clean_text for r in passages.marked(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "Another start of words here. A different end comes now."


# 3


def test_cascade_is_exact_for_its_universe(spark, tmp_path):
    from cytolake.llm.common import Stage

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"), "id")
    listed, rest = keys.filter("id % 7 = 0").select("h"), keys.filter("id % 7 <> 0").select("h")
    cascade = urls.fit(Stage(spark, "t"), listed, rest, "c")
    assert len(cascade.levels) > 1
    for df, want in ((listed, True), (rest, False)):
        assert (cascade.contains(df.toPandas()["h"].to_numpy().astype(np.uint64)) == want).all()


def test_shards_give_the_same_verdicts(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    one = sorted(map(tuple, urls.judge(spark, pages, urls.default_rules(spark)).collect()))
    monkeypatch.setattr(urls, "MAX_FILTER_BYTES", 4)
    assert sorted(map(tuple, urls.judge(spark, pages, urls.default_rules(spark)).collect())) == one


def test_a_url_of_very_many_labels(spark):
    url = "http://" + "a." * 10_000 + "org/x"
    pages = spark.createDataFrame([(1, url), (2, "http://" + "a." * 10_000 + "com/de/x")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark, pages, urls.default_rules(spark)).collect()}
    assert got == {1: ("org/", "allow"), 2: ("com/de/", "block")}


# 4


def test_ratios_and_fit_by_force(spark):
    """Log-count ratios and scores of all features against a plain dense fit."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["bad", "vile", "awful", "nice"] if i % 3 == 0 else ["good", "nice", "kind", "bad"]) for _ in range(6))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(10_000 + i, 1) for i in range(50)], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, labels, most=200)
    mark = np.zeros(1 << toxicity.BITS, dtype=bool)
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    y = np.array([i % 3 == 0 for i, _ in train], dtype=float)
    x = np.zeros((len(train), 1 << toxicity.BITS), dtype=np.float32)
    for k, (_, t) in enumerate(train):
        x[k, toxicity.feature_ids(t, mark)] = 1
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used].astype(float)
    p, q = (x[y == 1].sum(axis=0) + 1) / (y.sum() + 2), (x[y == 0].sum(axis=0) + 1) / ((1 - y).sum() + 2)
    scaled = x * np.log(p / q)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(20_000):
        e = (1 / (1 + np.exp(-(scaled @ w + b))) - y) / len(y)
        w -= 0.02 * (scaled.T @ e + toxicity.PENALTY * w)
        b -= 0.02 * e.sum()
    assert set(np.flatnonzero(weights)) <= set(used)
    mine, plain = x @ weights[used] + bias, scaled @ w + b
    assert ((mine > 0) == (plain > 0)).mean() > 0.98 and np.corrcoef(mine, plain)[0, 1] > 0.95


def test_toxicity_held_out(spark, sf_dir):
    got = queries.op4_toxicity(spark, sf_dir.replace("sf0.001", "sf0.01")).toPandas()
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet").toPandas()
    x = got.merge(labels, on="doc_id")
    assert (x.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in x.doc_id]).all()
    held = x[x.held_out]
    a, b = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (a[:, None] > b[None, :]).mean() > 0.9 and got.score.between(0, 1).all()


def test_scratch_array_is_left_clean():
    mark = np.zeros(1 << toxicity.BITS, dtype=bool)
    assert len(toxicity.feature_ids("hello there", mark)) and not mark.any()
    assert len(toxicity.feature_ids("ab", mark)) == 0


# 5


def test_packing_round_trip(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = queries.op5_packing(spark, sf_dir).toPandas()
    by_doc = dict(list(got.sort_values("start").groupby("doc_id")))
    for i, t in zip(docs.doc_id, docs.text):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        p = by_doc[i]
        assert p.start.tolist() == np.cumsum([0, *p.length])[:-1].tolist() and p.length.sum() == len(ids) == p.doc_tokens.iloc[0]
        assert p.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(p.start, p.length)]
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    fill = s.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.97


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    mine, library = packing.WordIds(tokenizer("word_bpe_49k.json")), Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rng = random.Random(2)
    alphabet = " \n\tabÉßAz0'sΣς.,!😀́\u3000\x00\x85\x1cİक़<|"
    for _ in range(5000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + ("<|endoftext|>" if rng.random() < 0.1 else "")
        assert mine.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_ids_of_many_texts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "TOGETHER", 300)
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rng = random.Random(3)
    pieces = ["ab", "Ab", "it's", "x", "é", "e\u0301", "Σ", "7", "!", "...", "***", "$%&", "'s", "'", "|>", "<|", "<|endoftext|>", "\x1c", "\u3000", " ", "\t", "\n ", "\u0338"]
    texts = [None, "", " ", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)), "long " * 200, None]
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (20, 10**6):
        mine, got = packing.WordIds(tokenizer("word_bpe_49k.json"), most), []
        for part in packing.slices(pa.array(texts)):
            ids, ends = mine.many(part)
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == wanted


def test_a_word_is_asked_once_whatever_marks_follow():
    mine = packing.WordIds(tokenizer("word_bpe_49k.json"))
    stems, marks = ["table", "chairs", "it's", "naïve"], ["", ".", "!", "***", "$$$", '.")', "|||"]
    mine.ids(" ".join(s + m for s in stems for m in marks))
    assert len(mine.memory) == len(stems) + len(marks) - 1


def test_plan_uses_up_every_length():
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        used = Counter()
        for pattern, times in packing.plan(counts, 64):
            assert sum(pattern) <= 64 and times > 0
            for c in pattern:
                used[c] += times
        assert used == Counter(counts)


# 6


def components_by_force(rows):
    sets, inverse = {}, {}
    for i, t in rows:
        w = re.findall(SPACE, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for h in sets[i]:
            inverse.setdefault(h, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for pair in {(a, b) for ids in inverse.values() for a in ids for b in ids if a < b}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(pair[0]), find(pair[1])
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def generated(seed):
    """Copies, near copies, shared passages and short texts over few words."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 60]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word().upper()
            rows.append((len(rows), " ".join(copy)))
    return rows


SMALL = {"FREQUENT": 2, "DENSE": 3, "BLOCK_SHINGLES": 256, "BLOCK_SETS": 40, "RANGE_SHINGLES": 64, "APART": 0, "HUB_PAIRS": 2, "BUCKET_PART": 3, "HELD_SETS": 2, "BROADCAST_ROWS": 0}


@pytest.mark.parametrize("seed,changed", [(1, {}), (2, {"FREQUENT": 3}), (3, SMALL), (4, SMALL | {"DENSE": 0}), (5, SMALL | {"DENSE": 99, "APART": 9})])
def test_jaccard_join_is_exact(spark, monkeypatch, seed, changed):
    """Also with every limit so low that blocks, ranges, parts, later hubs, dense sets and joins by a shuffle are many."""
    for name, value in changed.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = generated(seed)
    got = jaccard.join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(rows)


def test_jaccard_large_group_of_near_copies(spark):
    """Members of a group whose links are only a part of its pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    got = jaccard.join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(rows)


def test_jaccard_ids_that_repeat_or_miss(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (3, b + " c"), (None, a), (None, "nobody else has this text"), (7, a), (7, a), (9, None), (9, "")]
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([("5", 36, 5), ("5", 36, 3), ("3", 37, 3), ("None", 36, 5), ("None", 1, None), ("7", 36, 5), ("7", 36, 5), ("9", 0, 9), ("9", 0, 9)], key=str)


# 7


def test_pieces_equal_the_library():
    v = pieces.vocabulary(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(" ▁\n\tabéßAz0.😀́\u3000�\x00<s>") for _ in range(rng.randint(0, 30)))
        ids = v.encode(t)
        v.check(t, ids, v.decode(ids))
    with pytest.raises(ValueError):
        v.check("abc", v.encode("abd"), b"abd")


def test_every_kind_of_chunk_is_compared_with_the_library():
    v = pieces.Vocabulary(tokenizer("piece_bpe_32k.model"))
    assert v.chunk.findall("▁one,two▁▁3x▁") == ["▁one", ",", "two", "▁▁3", "x", "▁"]
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["the", "und", " ", "  ", ", ", ".", "\n", "é", "²", "0", "▁", "($", "Ω"]) for _ in range(rng.randint(0, 20)))
        ids = v.encode(t)
        v.check(t, ids, v.decode(ids))
    v.check_fresh()
    for chunk in ("▁one", "▁▁3", ",", "two", "▁", "▁▁"):
        ids = np.frombuffer(v.encode_chunk(chunk), dtype="<u4").tolist()
        for wrong in (ids[:-1], ids + ids):
            v.fresh = [v.in_text(chunk, wrong)]
            with pytest.raises(ValueError):
                v.check_fresh()


# 9


def test_fingerprints_are_homomorphic(spark):
    a, b = "One two three.\nFour five six seven eight", "Nine ten\n\nEleven, twelve."
    df = spark.createDataFrame([(a, b)], "a string, b string")
    fa, fb = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    both = fingerprints.fingerprint(F.concat("b", F.lit("\n"), "a"))
    r = df.select(both.alias("both"), fingerprints.add(fa, fb).alias("sum"), fa.alias("fa"), fb.alias("fb")).select("*", fingerprints.remove(F.col("sum"), F.col("fb")).alias("back"), fingerprints.likeness(F.col("fa"), F.col("sum")).alias("near")).first()
    assert r["both"] == r["sum"] and r["back"] == r["fa"] and 0 < r["near"] < 1


def test_fingerprint_by_force(spark):
    t = "Ab cd ef gh ij.\n\nkl mn. Op"
    got = spark.createDataFrame([(t,)], "t string").select(fingerprints.fingerprint(F.col("t"))).first()[0]
    h = lambda s, seed: xxhash.xxh64_intdigest(b"", 42) if s is None else _spark_hash(s, seed)

    def _spark_hash(s, seed):
        inner = xxhash.xxh64_intdigest(s.encode(), 42)
        return xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), inner)

    mask = fingerprints.MASK
    paragraphs = [p for p in t.split("\n") if p.strip()]
    units = re.findall(fingerprints.PIECE, t)
    want = [sum(h(p, s) & mask for p in paragraphs) & mask for s in (0, 1)] + [len(paragraphs), len(units)]
    for s in (0, 1):
        want += [sum((h(u, s) >> k) & fingerprints.SPREAD for u in units) & mask for k in range(fingerprints.LANE_BITS)]
    assert got == want


def test_edited_texts(spark, sf_dir, docs):
    got = queries.op9_multiset_hash(spark, sf_dir).toPandas().sort_values("doc_id")
    texts = docs.text.tolist()
    for k, (t, sha, n) in enumerate(zip(texts, got.edited_sha256, got.n_chars)):
        half = len(t) // 2
        assert n == len(t) and sha == hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][:half]).encode()).hexdigest()
    assert (got.near_edited > got.near_next).mean() > 0.95
    assert got.groupby(docs.text.to_numpy()).fingerprint.nunique().max() == 1


# 10


def test_base_scores(spark, sf_dir, docs):
    got = queries.op10_context_mixing(spark, sf_dir).toPandas().set_index("doc_id")
    words = {i: [*re.findall(SPACE, t.translate({c: c + 32 for c in range(65, 91)})), None] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, held[i])
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    assert (got.score < 0).all() and got.bits_per_byte.median() < 3.5


def test_next_byte_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = mixing.Model(rng.integers(0, 50, (mixing.OFFSETS[-1], 2)).astype(np.uint8), mixing.start_weights(), rng.random((256, mixing.APM_BINS)))
    context = np.uint64(0x6162632064)  # five bytes
    keys = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert np.sum(10.0 ** model.log10(keys)) == pytest.approx(1.0)


def test_windows_and_their_logs():
    keys, begin = mixing.windows([b"ab", b"", b"c"])
    assert [k & np.uint64(0xFF) for k in keys] == [97, 98, 255, 255, 99, 255] and begin.tolist() == [0, 3, 4]
    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    logs = -rng.random(len(known))
    at = rng.integers(0, len(known), 20_000)
    assert (mixing.looked_up(known[at], known, logs) == logs[at]).all()


def test_scores_depend_on_the_documents_only(spark, sf_dir, monkeypatch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = mixing.score(spark, d.coalesce(1)).toPandas().sort_values("doc_id")
    for name, value in {"BLOCK_BYTES": 40_000, "BLOCK_ROWS": 17, "SHARD_BYTES": 50_000, "SLICE": 500, "WORD_BYTES": 60_000, "PIECE_BYTES": 70_000}.items():
        monkeypatch.setattr(mixing, name, value)
    many = mixing.score(spark, d.repartition(8)).toPandas().sort_values("doc_id")
    assert np.allclose(one.score, many.score, rtol=1e-9) and np.allclose(one.base_score, many.base_score, rtol=1e-12)
    assert (one.train_tokens.to_numpy() == many.train_tokens.to_numpy()).all()


def test_mixing_drops_the_questions_and_shuffle_files_of_each_step(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"word {i % 7} and {i * i} more of it") for i in range(300)], "doc_id long, text string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    last_shuffle = lambda: max(map(int, re.findall(r"shuffle_(\d+)", manager.getAllFiles().mkString(" "))), default=-1)
    stages, gone, tables, last = [], [], [], mixing.scored

    class Stage(common.Stage):
        def settle(self):
            newest, end = last_shuffle(), time.time() + 20
            super().settle()
            while last_shuffle() == newest and time.time() < end:  # Spark removes the files a little later
                time.sleep(0.2)
            gone.append(last_shuffle() < newest)

    def scored(*args):
        root = Path(stages[0].root)
        tables.extend(sorted({str(p.parent.relative_to(root)) for p in root.rglob("*.parquet")}))
        return last(*args)

    monkeypatch.setattr(mixing, "Stage", lambda *args: stages.append(Stage(*args)) or stages[-1])
    monkeypatch.setattr(mixing, "scored", scored)
    assert mixing.score(spark, d).count() == 300
    assert gone == [True] * 4
    assert tables == ["blocks/kind=text", "pieces", "windows", "words"]


def test_scores_of_unseen_texts_beat_the_base(spark, sf_dir):
    got = mixing.score(spark, spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_weights_are_learned_from_all_windows(spark, sf_dir, monkeypatch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen, answer = [], mixing.window_answers
    monkeypatch.setattr(mixing, "window_answers", lambda asked, grams, held, weights, apm: seen.append((grams.toArrow(), weights, mixing.low_tables(*held.value), apm)) or answer(asked, grams, held, weights, apm))
    mixing.score(spark, d)
    grams, w, tables, apm = seen[0]
    loss, slope, bend, places = 0.0, np.zeros(w.shape), np.zeros((*w.shape, w.shape[1])), np.zeros((2, 256, mixing.APM_BINS))
    windows = 0
    for keys, n in mixing.slice_rows(grams):
        high, pick = mixing.high_counts(keys, n), np.flatnonzero(n)
        keys, n, high = keys[pick], n[pick].astype(float), high[:, :, pick]
        words, row = mixing.word_order(keys), np.arange(len(keys))
        windows += len(keys)
        for bit in range(8):
            q, b = mixing.pairs_of(tables, high, keys, words, bit), mixing.bits_of(keys, bit)
            q[:, row, b] = mixing.without_one(q[:, row, b])
            x, g = mixing.inputs(q)
            z = np.einsum("ei,ei->e", x, w[g])
            p = mixing.squash(z)
            loss -= np.sum(n * np.log(np.where(b == 1, p, 1 - p)))
            low, up = mixing.apm_place(z)
            node = (1 << bit) | ((keys & np.uint64(0xFF)) >> np.uint64(8 - bit)).astype(np.int64)
            for k, share in ((low, 1 - up), (low + 1, up)):
                np.add.at(places, (0, node, k), n * share * b)
                np.add.at(places, (1, node, k), n * share)
            for gate in np.unique(g):
                of = g == gate
                v = x[of].astype(float)
                slope[gate] += (n[of] * (b - p)[of]) @ v
                bend[gate] += (v * (n * p * (1 - p))[of][:, None]).T @ v
    assert windows > 100_000
    # no step of any gate promises more than a little, so no window's share is missing
    gain = sum(s @ np.linalg.lstsq(h + np.eye(len(h)), s)[0] for s, h in zip(slope, bend))
    assert gain < 1e-3 * loss
    ones, seen_before = mixing.start_apm()
    assert np.allclose(apm, (ones + places[0]) / (seen_before + places[1]), atol=1e-8)


def plain_guesses(key, own, train):
    """As ``guesses``, piece by piece."""
    out = []
    for k, x, t in zip(key, own, train):
        after = Counter(b for a, b, m in zip(key, own, train) if a == k and m)
        top = min((b for b in {b for a, b in zip(key, own) if a == k}), key=lambda b: (-after[b], b))
        if t:
            after[x] -= 1
        others = max((n for b, n in after.items() if b != top), default=0)
        best = max(after[top], others)
        right = x == top and after[top] > 0 and (not t or after[top] > others)
        out.append(0 if best <= 0 else 1 + 2 * min(mixing.SEEN - 1, int(np.log2(best))) + right)
    return out


def test_guesses_by_force():
    rng = np.random.default_rng(6)
    key, own, train = rng.integers(0, 12, 400), rng.integers(0, 4, 400) ** 2, rng.random(400) < 0.7
    assert mixing.guesses(key, own, train).tolist() == plain_guesses(key.tolist(), own.tolist(), train.tolist())


def test_one_text_byte_by_byte():
    """The refinement along texts against a plain walk over their bytes."""
    rng = random.Random(9)
    line = " ".join(f"word{rng.randrange(40)}" for _ in range(12)) + "\n"
    texts = [(line * 6 + "other words here " + line).encode(), b"", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", b"x " * 40 + b"y " + b"x " * 30]
    asked = mixing.Asked(texts, [True, False, True, False], (1, 1, 1))
    value = np.random.default_rng(3).random(len(asked.windows)) * -1.5 - 0.05
    order = np.argsort(asked.windows)
    logs = mixing.looked_up(asked.at, asked.windows[order], value[order])
    found = np.random.default_rng(5).integers(0, 2 * mixing.SEEN + 1, len(asked.order)).astype(np.uint8)
    rates = np.array([0.2, 0.4, 0.6, 0.8])
    want = []
    for i, (b, m) in enumerate(zip(asked.begin, asked.sizes)):
        at, own = asked.at[b : b + m].tolist(), logs[b : b + m]
        known, total, run, row = np.zeros(m, dtype=bool), 0.0, 0, [[0, 0.0, 0.0] for _ in mixing.RUNS]
        for j in np.flatnonzero(asked.pieces.owner == i):
            f = int(found[j])
            p = min(max((mixing.PIECE_PRIOR * rates[(f - 1) // 2] + run) / (mixing.PIECE_PRIOR + run), mixing.PIECE_LEAST), 1 - mixing.PIECE_LEAST)
            hit = f > 0 and f % 2 == 0
            total += 0.0 if f == 0 else np.log10(p if hit else 1 - p)
            run = run + 1 if hit else 0
            if hit:
                known[asked.pieces.start[j] - b : asked.pieces.end[j] - b] = True
        last, run = {}, 0
        for t in range(m):
            q, before = own[t], last.get(at[t] >> 8)
            hit = before is not None and at[before] == at[t]
            if before is not None and run >= mixing.RUNS[0]:
                c = row[sum(run >= r for r in mixing.RUNS) - 1]
                p = min(max(10.0 ** own[before], 1e-6), 1 - 1e-6)
                k = mixing.BYTE_PRIOR
                odds = lambda x: np.log(x / (1 - x))
                z = odds(p) + odds((c[1] + k / 2) / (c[0] + k)) - odds((c[2] + k / 2) / (c[0] + k))
                g = min(max(1 / (1 + np.exp(-z)), 1e-6), 1 - 1e-6)
                q = np.log10(g) if hit else q + np.log10((1 - g) / (1 - p))
                c[0], c[1], c[2] = c[0] + 1, c[1] + hit, c[2] + p
            total += 0.0 if known[t] else q
            run, last[at[t] >> 8] = run + 1 if hit else 0, t
        want.append(total)
    assert mixing.text_scores(asked, logs, found, rates) == pytest.approx(want)


def test_counts_of_contexts_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    # more contexts than any table of 2^22 slots tells apart, and a few that recur
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 48, 3_000_000, dtype=np.uint64) & ~np.uint64(0xFFFF000000) | np.uint64(0x4142000000), np.frombuffer(b"aabcde\0\0aabcdf\0\0xxbcde\0\0", dtype=">u8") >> np.uint64(16)]))
    n = rng.integers(1, 5, len(keys))
    high = mixing.high_counts(keys, n)
    for at in [*rng.integers(0, len(keys), 5), *np.searchsorted(keys, np.frombuffer(b"aabcde\0\0xxbcde\0\0", dtype=">u8") >> np.uint64(16))]:
        for order in range(3, 6):
            own = keys >> np.uint64(8) & np.uint64((1 << 8 * order) - 1) == keys[at] >> np.uint64(8) & np.uint64((1 << 8 * order) - 1)
            for bit in range(8):
                node = own & ((keys & np.uint64(0xFF)) >> np.uint64(8 - bit) == (keys[at] & np.uint64(0xFF)) >> np.uint64(8 - bit))
                ones = node & (mixing.bits_of(keys, bit) == 1)
                assert high[order - 3, bit, at].tolist() == mixing.quantised(np.array([n[node & ~ones].sum(), n[ones].sum()])).tolist()


def test_count_steps_reach_the_total_of_a_large_corpus():
    n = np.array([0, 63, 64, 30_000_000_000, 10**15])
    assert (mixing._STEPS[mixing.quantised(n)] > 0.9 * n - 1).all()


# pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"kept": F.lit(1), "removed": F.lit("r"), "gone": F.lit("g")})
    columns = docs.columns
    for name, step in c.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == columns, name
        docs = out.cache()
        assert docs.count() > 0
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in c.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").collect()} == kept
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id").toPandas()
    assert judged[(judged.quality == 1) & ~judged.base_failed].kept.all()


def test_one_of_each_group_stays(spark):
    """Ids that repeat or miss, rows that repeat, and columns with the operators' names."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a, 1), (5, b, 2), (3, b + " c", 3), (None, a, 4), (None, "nobody else has this text here", 5), (7, a, 6), (7, a, 6), (8, "twice the same row is here", 7), (8, "twice the same row is here", 7), (9, None, 8), (9, "", 9), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumns({"class": F.lit("x"), "best": F.lit("y")})
    got = jaccard.keep_one(spark, docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text, r.key) for r in got.collect()), key=str)
    assert kept == sorted([(5, a, 1), (3, b + " c", 3), (None, "nobody else has this text here", 5), (8, "twice the same row is here", 7), (9, None, 8), (9, "", 9), (9, "", 9)], key=str)


ODD_ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "One short line"), (4, "One short line"), (None, "no id at all, but a whole sentence of words."), (6, "x" * 30_000)]


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "substring_dedup", "personal_data", "packing"])
def test_pipeline_stages_take_odd_rows(spark, sf_dir, name):
    import corpus_pipeline as c

    docs = spark.createDataFrame(ODD_ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "kept": F.lit(1), "n": F.lit(2), "key": F.lit("k"), "spans": F.lit("s")})
    step = dict(c.STAGES)[name]
    out = step(spark, docs, sf_dir)
    n = out.count()
    if name == "quality_rules":
        assert n == 0
    elif name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == ["1", "2", "3", "4", "6", "None"]
    elif name == "packing":
        assert {r.doc_id for r in out.select("doc_id").collect()} == {1, 2, 3, 4, None, 6}
    else:
        assert n == len(ODD_ROWS) and out.columns == docs.columns
    assert step(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_run_by_force(spark, sf_dir, docs, tmp_path):
    """The stages of a whole run against plain versions of them, on every text of the smallest table."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)]
    rows += [(10_000 + i, t) for i, t in rows[:40]] + [(20_000, rows[0][1]), (20_000, rows[50][1] + " more words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = c.run(spark, str(tmp_path)).toPandas()
    kept = [(r.doc_id, r.clean_text) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").collect()]
    root = {}
    named = {k: t for k, t in enumerate(kept)}
    for k, (_, comp) in components_by_force([(k, t) for k, (_, t) in named.items()]).items():
        if comp not in root or kept[k][0] < kept[root[comp]][0]:
            root[comp] = k
    left = sorted(kept[k] for k in root.values())
    first, cleaned = {}, []
    for i, t in left:
        cut = [(a, b) for k, (a, b, u) in enumerate(passages.units(t)) if len(u.split()) >= passages.LEAST and first.setdefault(u, (i, k)) != (i, k)]
        cleaned.append((i, passages.without(t, cut)))
    frame = spark.createDataFrame(cleaned, "doc_id long, text string")
    final = {r.doc_id: r.text for r in pii.redact(frame, pii.train(frame)).collect()}
    assert not any(plain_spans(t) for t in final.values())
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    assert set(got.doc_id) == set(final)
    for i, part in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*tok.encode(final[i], add_special_tokens=False).ids, 1], dtype="<u4")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length)] == part.ids_crc32.tolist()
        assert part.length.sum() == len(ids)


def test_pipeline_batches_and_word_memory_are_bounded(spark, sf_dir, monkeypatch):
    """A stage hands workers small batches, ``run`` sets the session back, and no result depends on either bound."""
    import corpus_pipeline as c
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def rows():
        return sorted(map(tuple, c.run(spark, sf_dir).collect()))

    docs = spark.range(2000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")
    for key in c.BATCHES:
        spark.conf.unset(key)
    before = {key: spark.conf.get(key) for key in c.BATCHES}
    try:
        whole = rows()
        assert {key: spark.conf.get(key) for key in c.BATCHES} == before
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) > 9e6
        c.personal_data(spark, docs.limit(5), sf_dir)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 3e6
        monkeypatch.setattr(c, "BATCHES", dict(zip(c.BATCHES, ("2k", "7"), strict=True)))
        monkeypatch.setattr(c, "WORDS", 50)
        assert rows() == whole
    finally:
        for key in before:
            spark.conf.unset(key)


def test_word_memory_keeps_its_bound():
    few = packing.WordIds(tokenizer("word_bpe_49k.json"), 100)
    texts = [" ".join(f"word{k}x{i}" for i in range(40)) for k in range(60)]
    many = packing.WordIds(tokenizer("word_bpe_49k.json"))
    assert all((few.ids(t) == many.ids(t)).all() for t in texts)
    assert len(few.memory) <= 100 and len(few.older) <= 100 and len(many.memory) == 2400

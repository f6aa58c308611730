"""URL filter: exact rule lookup through cascades of Bloom filters, without joins.

The listed keys are the rules' (host + path); the key universe is every
candidate key that some url of the corpus gives rise to (each ending of its
host of as many labels as some listed host has, with each prefix of its path
that is as long as some listed path).  Level 1 of a cascade encodes the listed keys; level 2 the
universe's keys that pass level 1 without being listed; level 3 the listed
keys that pass level 2, and so on until nothing passes wrongly.  The first
level that a key fails tells whether it is listed, exactly, for every key of
the universe.

Sizes: level 1 has a false-positive rate of about (listed / unlisted) * 0.7,
the others one half, so a cascade takes about listed * (1.44 * log2(unlisted /
listed) + 6) bits whatever the corpus' size in rows.  Only filters go to the
executors, and only up to ``MAX_FILTER_BYTES``: a larger list is split into
shards by a hash of the key, each with a cascade of its own, and candidates are
looked up one shard a pass.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule and the default verdict; hosts and keys are compared byte for byte after
A-Z are lower-cased; an empty rule list fits nothing; repeated rows are judged
each by itself.  Keys are known by 64-bit hashes: a key with the hash of a
listed one counts as listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, let

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Verdict of a url that no listed key fits.
DEFAULT = "allow"
#: Largest total of filters sent to the executors at once.
MAX_FILTER_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def candidates(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """Array of a url's candidate keys, each once, the longest host and path first.

    Only host endings of as many labels and path beginnings of as many characters
    as some rule has, so a long url has no more of them than a short one.
    """
    ending = lambda ls, n: F.when(F.size(ls) >= n, F.array_join(F.slice(ls, F.size(ls) - n + 1, n), "."))
    suffixes = let(F.split(host, r"\."), lambda ls: F.array(*[ending(ls, n) for n in sorted(set(labels), reverse=True)]))
    suffixes = F.filter(suffixes, lambda h: h.isNotNull())
    paths = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)])
    paths = F.filter(paths, lambda p: p.isNotNull())
    return F.when(F.length(host) > 0, F.flatten(F.transform(suffixes, lambda h: F.transform(paths, lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))


@dataclass
class Level:
    """A Bloom filter: ``hashes`` positions a key by double hashing in ``bits`` bits."""

    bits: int
    hashes: int
    words: np.ndarray = field(repr=False)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), dtype=bool)
        for i in range(self.hashes):
            at = (h1 + np.uint64(i) * h2) % np.uint64(self.bits)
            ok &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def level_hashes(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for one level from a key's 64-bit hash (finaliser of splitmix64)."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    salt = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mix(h + salt), mix(h ^ salt) | np.uint64(1)


class Cascade:
    """Exact membership of listed keys among the keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Whether each key (by its 64-bit hash) is listed: the parity of the first level that it fails."""
        h = h.astype(np.uint64)
        inside = np.full(len(h), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h))
        for n, level in enumerate(self.levels):
            ok = level.passes(*level_hashes(h[open_], n))
            inside[open_[~ok]] = n % 2 == 1
            open_ = open_[ok]
        return inside


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _passes(level: Level, number: int, h: Column) -> Column:
    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(level.passes(*level_hashes(x.to_numpy().astype(np.uint64), number)))

    return test(h)


def _build(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A level over the hashes ``h`` of ``keys``; its words are gathered by their place, not the keys."""
    rate = min(0.5, max(rate, 1e-6))
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    bits = (bits + 63) // 64 * 64
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))

    def places(batches):
        for b in batches:
            h1, h2 = level_hashes(b["h"].to_numpy().astype(np.uint64), number)
            at = np.concatenate([(h1 + np.uint64(i) * h2) % np.uint64(bits) for i in range(hashes)])
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    found = keys.select("h").mapInPandas(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def fit(stage: Stage, listed: DataFrame, universe: DataFrame, name: str) -> Cascade:
    """A cascade for ``listed`` (distinct hashes ``h``) over ``universe`` (distinct hashes ``h`` without those).

    Every level reads what passed the level before it on its side, so the work
    halves from level to level; both sides are written between the levels.
    """
    sides = [listed, universe]
    counts = [listed.count(), universe.count()]
    levels: list[Level] = []
    rate = 0.7 * counts[0] / max(counts[1], 1)
    while counts[len(levels) % 2]:
        n = len(levels)
        mine, other = n % 2, 1 - n % 2
        levels.append(_build(sides[mine], counts[mine], rate, n))
        rate = 0.5
        sides[other] = stage.save(sides[other].filter(_passes(levels[n], n, F.col("h"))), f"{name}_{n}")
        counts[other] = sides[other].count()
    return Cascade(levels)


def shards_of(n_listed: int, n_universe: int) -> int:
    """How many cascades keep each one's filters under the bound."""
    bits = n_listed * (1.44 * math.log2(max(2, n_universe / max(n_listed, 1))) + 8)
    return max(1, math.ceil(bits / 8 / MAX_FILTER_BYTES))


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path and verdict (allow or block)."""
    stage = Stage(spark, "urls")
    lengths = [r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    labels = [r["n"] for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()]
    split = pages.drop("host", "path", "rule", "verdict")
    host, path = host_path(F.col(url))
    split = split.withColumns({"host": host, "path": path})
    if not lengths:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = rules.select(key_hash(F.concat("host", "path")).alias("h"), "verdict").groupBy("h").agg(F.min("verdict").alias("verdict"))
    keyed = stage.save(keyed, "listed")
    seen = split.select(F.explode(candidates(F.col("host"), F.col("path"), lengths, labels)).alias("key")).select(key_hash(F.col("key")).alias("h"))
    universe = stage.save(seen.distinct().join(keyed.select("h"), "h", "left_anti"), "universe")
    shards = shards_of(keyed.count(), universe.count())
    for s in range(shards):
        mine = lambda df: df.filter(F.pmod(F.col("h"), F.lit(shards)) == s) if shards > 1 else df  # noqa: B023, E731
        listed = mine(keyed)
        any_rule = fit(stage, listed.select("h"), mine(universe), f"any{s}")
        blocked = listed.filter(F.col("verdict") == "block").select("h")
        allowed = listed.filter(F.col("verdict") != "block").select("h")
        blocks = fit(stage, blocked, allowed, f"block{s}")
        split = _look_up(split, any_rule, blocks, lengths, labels, s, shards)
        if shards > 1:  # one shard's filters are with the executors at a time: each pass is written before the next
            best = F.col("_found") if not s else F.when(F.coalesce(F.length("_found.rule"), F.lit(-1)) > F.coalesce(F.length("_best.rule"), F.lit(-1)), F.col("_found")).otherwise(F.col("_best"))
            split = stage.save(split.withColumn("_best", best).drop("_found"), f"pass_{s}").withColumn("_found", F.col("_best"))
    verdict = F.when(F.col("_found.rule").isNull(), F.lit(default)).when(F.col("_found.block"), F.lit("block")).otherwise(F.lit("allow"))
    return split.withColumns({"rule": F.col("_found.rule"), "verdict": verdict}).drop("_best", "_found")


def _look_up(split: DataFrame, any_rule: Cascade, blocks: Cascade, lengths: list[int], labels: list[int], shard: int, shards: int) -> DataFrame:
    """Column ``_found``: the longest listed key among a url's candidates, and whether it blocks."""

    @F.pandas_udf("struct<rule string, block boolean>")
    def longest(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(x) for x in keys], dtype=np.int64)
        rule, block = [None] * len(keys), [None] * len(keys)
        if sizes.sum():
            h = np.concatenate([np.asarray(x, dtype=np.int64) for x in hashes if len(x)]).view(np.uint64)
            row = np.repeat(np.arange(len(keys)), sizes)
            hit = any_rule.contains(h)
            if shards > 1:
                hit &= h.view(np.int64) % shards == shard
            bad = blocks.contains(h)
            flat = [k for x in keys for k in x]
            for i in np.flatnonzero(hit):
                r = row[i]
                if rule[r] is None or len(flat[i]) > len(rule[r]):
                    rule[r], block[r] = flat[i], bool(bad[i])
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "block": pd.Series(block, dtype=object)})

    keys = candidates(F.col("host"), F.col("path"), lengths, labels)
    return split.withColumn("_found", let(keys, lambda k: F.struct(k.alias("k"), F.transform(k, key_hash).alias("h")))).withColumn("_found", longest(F.col("_found.k"), F.col("_found.h")))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")

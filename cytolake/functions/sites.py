"""Scalar functions on sites: states, coverage, chromosome names, entropy, kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = 0.9, 0.1
#: Contexts that count as CG where a set is used instead of a prefix.
CG_CONTEXTS = ("CGG", "CGC", "CGA", "CGT", "CGN", "CG", "CpG")


def is_cg(context: Column) -> Column:
    up = F.upper(context)
    return up.startswith("CG") | (up == "CPG")


def coverage(meth: Column, other: Column, other_is_total: bool, inverted: bool = False) -> Column:
    """Total coverage from the methylated count and a second one (total or unmethylated)."""
    return other if other_is_total != inverted else other + meth


def ratio(meth: Column, cov: Column) -> Column:
    """Methylated share; null without coverage."""
    return F.when(cov > 0, meth.cast("double") / cov.cast("double"))


def trinarise(share: Column, high: float = HIGH, low: float = LOW, ambiguous: int | None = 0) -> Column:
    """1 methylated, -1 unmethylated, else ``ambiguous``; null for a null share."""
    return F.when(share >= high, F.lit(1)).when(share <= low, F.lit(-1)).when(share.isNotNull(), F.lit(ambiguous).cast("int"))


def binarise(share: Column, ceiling: float = HIGH, floor: float = LOW) -> Column:
    """1 above the ceiling, 0 up to the floor, -1 between."""
    return F.when(share > ceiling, F.lit(1)).when(share <= floor, F.lit(0)).otherwise(F.lit(-1))


def chrom_name(chrom: Column, style: str = "keep") -> Column:
    """Chromosome name with (``add_chr``) or without (``remove_chr``) its prefix, or as it is."""
    has = chrom.startswith("chr")
    if style == "add_chr":
        return F.when(has, chrom).otherwise(F.concat(F.lit("chr"), chrom))
    if style == "remove_chr":
        return F.when(has, F.substring(chrom, 4, 1 << 20)).otherwise(chrom)
    if style == "keep":
        return chrom
    if style == "bare_upper":
        return F.regexp_replace(F.upper(chrom), "^CHR", "")
    raise ValueError(f"unknown style {style!r}")


def region_name(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_region(name: Column) -> tuple[Column, Column, Column]:
    """chrom, start and end of a name ``chrom:start-end``."""
    pick = lambda k: F.regexp_extract(name, r"^(.*):(\d+)-(\d+)$", k)
    number = lambda c: F.when(c != "", c).cast("long")
    return pick(1), number(pick(2)), number(pick(3))


def entropy(p: Column) -> Column:
    """Binary entropy in bits; 0 at the ends."""
    term = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))
    return F.when(p.isNotNull(), term(p) + term(1 - p))


def tricube(distance: Column, half: int) -> Column:
    return F.pow(1 - F.pow(F.abs(distance) / float(half), 3), 3)


def gaussian(distance: Column, bandwidth: Column) -> Column:
    return F.exp(-F.pow(distance / bandwidth, 2))


def neg_log10(p: Column) -> Column:
    return -F.log10(p)


def logistic(x: Column) -> Column:
    """Inverse of the log odds, without overflow for large arguments."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length: over 0 overlapping, 0 book-ended, below 0 the distance."""
    return F.least(end_a, end_b) - F.greatest(start_a, start_b)


def volcano_class(lfc: Column, p: Column, alpha: float = 0.05, least: float = 0.5) -> Column:
    strong = (p < alpha) & (F.abs(lfc) > least)
    return F.when(strong & (lfc > 0), "hyper").when(strong & (lfc < 0), "hypo").otherwise("nonsignificant")


#: Feature names and what they stand for; fixed values.
FEATURE_NAMES = {"5UTR": "five_prime_utr", "3UTR": "three_prime_utr"}
#: Colours of states; fixed values.
STATE_COLOURS = {0: "white", 1: "red", -1: "blue"}


def mapped(value: Column, names: dict) -> Column:
    """The value's entry in a small table, or the value itself."""
    out = value
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def feature_name(name: Column) -> Column:
    return mapped(name, FEATURE_NAMES)


def state_colour(state: Column) -> Column:
    """Colour of a state; null for others."""
    out = F.lit(None).cast("string")
    for k, v in STATE_COLOURS.items():
        out = F.when(state == k, F.lit(v)).otherwise(out)
    return out


def slop(start: Column, end: Column, before: int, after: int) -> tuple[Column, Column]:
    """An interval made longer at both ends, its start not below 0."""
    return F.greatest(F.lit(0).cast("long"), start - before), end + after


def motif_name(name: Column) -> Column:
    """Upper-cased first part of a motif's name, which ends at a slash, colon, parenthesis or hyphen."""
    return F.upper(F.regexp_extract(name, r"^([^/:()-]*)", 1))


def motif_id(file_name: Column) -> tuple[Column, Column]:
    """Id and factor of a file name ``id_factor.suffix``."""
    bare = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.regexp_extract(bare, r"^([^_]*)", 1), F.regexp_extract(bare, r"^[^_]*_(.*)$", 1)


def composite(*values: Column) -> Column:
    return F.concat_ws("_", *values)


def shortened(genes: Column, most: int, sep: str = ";") -> Column:
    """The first names of a joined list, with an ellipsis if there are more."""
    parts = F.split(genes, sep)
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), sep), F.lit("..."))).otherwise(genes)


def stars(p: Column) -> Column:
    """One to three stars for a p-value below 0.05, 0.01 and 0.001."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def is_binary(value: Column) -> Column:
    """Aggregate: whether all values are 0 or 1."""
    return F.coalesce(F.bool_and(value.isin(0, 1)), F.lit(True))

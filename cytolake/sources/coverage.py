"""Per-cell coverage files: formats, scan, bad records and format detection."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sites import HIGH, LOW, chrom_name, coverage, is_cg, ratio, trinarise


@dataclass(frozen=True)
class CoverageFormat:
    """Column places (from 0) of a coverage file; ``other`` is the total if ``is_total``, else the unmethylated count.

    Without ``other`` the ``meth`` column is a ratio.
    """

    chrom: int
    pos: int
    meth: int
    other: int | None = None
    context: int | None = None
    is_total: bool = False
    sep: str = "\t"
    header: bool = False

    @property
    def places(self) -> list[int]:
        return [p for p in (self.chrom, self.pos, self.meth, self.other, self.context) if p is not None]


#: Column places of the supported tools' files.
PRESETS = {
    "bismark": CoverageFormat(0, 1, 3, 4, 5, False),
    "bsseeker": CoverageFormat(0, 2, 6, 7, 3, True),
    "bsseeker2": CoverageFormat(0, 2, 6, 7, 3, True),
    "methylpy": CoverageFormat(0, 2, 6, 7, 3, True),
    "allc": CoverageFormat(0, 1, 4, 5, 3, True, header=True),
}
SEPARATORS = {"\\t": "\t", "tab": "\t", "t": "\t", ",": ",", "comma": ",", " ": " ", "space": " "}


def resolve(spec: str | CoverageFormat) -> CoverageFormat:
    """A preset's name, a format, or a custom text.

    Custom texts count columns from 1: ``chrom:pos:meth:N[c|u]:context:sep:header``
    (c: N is the total, u: the unmethylated count) or ``chrom:pos:value:sep:header``
    for ratios.
    """
    if isinstance(spec, CoverageFormat):
        return spec
    if spec in PRESETS:
        return PRESETS[spec]
    parts = spec.split(":")
    flag = {"0": False, "1": True, "false": False, "true": True}
    try:
        sep = SEPARATORS.get(parts[-2].lower(), parts[-2])
        header = flag[parts[-1].lower()]
        if len(parts) == 5:
            c, p, v = (int(x) - 1 for x in parts[:3])
            return CoverageFormat(c, p, v, sep=sep, header=header)
        if len(parts) == 7:
            c, p, m = (int(x) - 1 for x in parts[:3])
            kind = re.fullmatch(r"(\d+)([cuCU])", parts[3])
            if kind:
                return CoverageFormat(c, p, m, int(kind[1]) - 1, int(parts[4]) - 1, kind[2] in "cC", sep, header)
    except (KeyError, ValueError, IndexError):
        pass
    raise ValueError(f"not a coverage format: {spec!r} (a preset, 5 or 7 parts)")


def cell_name(path: Column) -> Column:
    """File name without its folder and endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.(gz|bz2|txt|tsv|csv|bed|cov|allc|CG|CGmap))+$", "")


def scan(spark: SparkSession, path: str, spec: str | CoverageFormat = "bismark", glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Every line of the files with its parsed fields; ``bad`` tells why a line is no record (null: it is one).

    Lines that start with ``#`` and blank lines are left out; gzip is read as it is.
    """
    f = resolve(spec)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    lines = lines.select(cell_name(F.col("_metadata.file_path")).alias("cell_name"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    lines = lines.filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", "\\s+" if f.sep == " " else re.escape(f.sep))
    column = lambda k: F.get(parts, F.lit(k)) if k is not None else F.lit(None).cast("string")
    whole = lambda k: F.expr(f"try_cast(trim(get(parts, {k})) as bigint)")
    out = lines.withColumn("parts", parts)
    out = out.withColumns(
        {
            "chrom": column(f.chrom),
            "pos": whole(f.pos),
            "context": F.upper(column(f.context)),
            "meth": whole(f.meth) if f.other is not None else F.lit(None).cast("long"),
            "other": whole(f.other) if f.other is not None else F.lit(None).cast("long"),
            "share": F.lit(None).cast("double") if f.other is not None else F.expr(f"try_cast(trim(get(parts, {f.meth})) as double)"),
        }
    )
    counts = F.col("meth").isNull() | F.col("other").isNull() if f.other is not None else F.col("share").isNull()
    bad = F.when(F.size("parts") <= max(f.places), "too few columns").when(F.col("pos").isNull(), "no position").when(counts, "no counts")
    if f.header:  # a header names its columns, so its position is no number
        out = out.withColumn("bad", bad).filter(~(F.col("bad").isNotNull() & F.col("pos").isNull() & (F.col("at") == 0) & F.lower(F.col("line")).rlike("chr|pos")))
    else:
        out = out.withColumn("bad", bad)
    return out.drop("at")


def sites(scanned: DataFrame, spec: str | CoverageFormat = "bismark", cg: bool | None = True, min_cov: int = 1, high: float = HIGH, low: float = LOW, style: str = "add_chr", inverted: bool = False) -> DataFrame:
    """Records as sites: cell_id by name, coverage, state; CG (True), non-CG (False) or all contexts (None).

    Ratios carry no coverage and pass the coverage bound.
    """
    f = resolve(spec)
    good = scanned.filter("bad IS NULL")
    if f.context is not None and cg is not None:
        good = good.filter(is_cg(F.col("context")) if cg else ~is_cg(F.col("context")))
    cov = coverage(F.col("meth"), F.col("other"), f.is_total, inverted) if f.other is not None else F.lit(None).cast("long")
    good = good.withColumn("cov", cov).filter(F.col("cov").isNull() | (F.col("cov") >= min_cov))
    share = F.coalesce("share", ratio(F.col("meth"), F.col("cov")))
    return good.select("cell_name", chrom_name(F.col("chrom"), style).alias("chrom"), "pos", "meth", "cov", "context", trinarise(share, high, low).alias("state"))


def with_cell_ids(rows: DataFrame) -> DataFrame:
    """cell_id by the order of the cells' names."""
    from pyspark.sql import Window

    names = rows.select("cell_name").distinct().withColumn("cell_id", (F.row_number().over(Window.orderBy("cell_name")) - 1).cast("int"))
    return rows.join(names, "cell_name")


def merge_duplicates(rows: DataFrame) -> DataFrame:
    """Rows of one cell and position added up, their state from the sums."""
    out = rows.groupBy("cell_id", "chrom", "pos").agg(F.sum("meth").alias("meth"), F.sum("cov").alias("cov"))
    return out.withColumn("state", trinarise(ratio(F.col("meth"), F.col("cov"))))


def sniff(spark: SparkSession, path: str, lines: int = 10_000) -> CoverageFormat:
    """The format that a file's first lines look like: separator, header, and the columns' places."""
    rows = [r["value"] for r in spark.read.text(path).limit(lines).collect() if r["value"].strip() and not r["value"].startswith("#")]
    if not rows:
        raise ValueError("no lines")
    sep = max("\t, ", key=lambda s: sum(r.count(s) for r in rows[:100]))
    table = [r.split(sep) for r in rows]
    header = not any(x.strip().lstrip("-").isdigit() for x in table[0])
    body = [r for r in table[header:] if len(r) == len(table[-1])]
    columns = list(zip(*body, strict=True))
    whole = lambda c: all(x.strip().isdigit() for x in c)
    chrom = next(i for i, c in enumerate(columns) if all(re.fullmatch(r"(chr)?(\d{1,2}|[XYM]|MT|\w+_\w+)", x) for x in c[:100]))
    pos = next(i for i, c in enumerate(columns) if i != chrom and whole(c) and sum(int(x) > 100 for x in c[:100]) >= min(50, len(c[:100]) / 2))
    context = next((i for i, c in enumerate(columns) if i not in (chrom, pos) and all(re.fullmatch(r"C[ACGTHN]{0,2}|CpG", x) for x in c[:100])), None)
    counts = [i for i, c in enumerate(columns) if i not in (chrom, pos, context) and whole(c)]
    if len(counts) >= 2:
        a, b = counts[-2:]
        within = sum(int(x) <= int(y) for x, y in zip(columns[a], columns[b], strict=True)) == len(body)
        ratios = [c for i, c in enumerate(columns) if i not in (chrom, pos, context, a, b) and any("." in x for x in c[:100])]
        total = within and bool(ratios) and sum(int(y) > 0 and abs(int(x) / int(y) - float(r)) < 0.01 for x, y, r in zip(columns[a], columns[b], ratios[0], strict=True)) > len(body) / 2
        return CoverageFormat(chrom, pos, a, b, context, total, sep, header)
    value = next(i for i, c in enumerate(columns) if i not in (chrom, pos, context) and any("." in x or x in "01" for x in c[:100]))
    return CoverageFormat(chrom, pos, value, None, context, False, sep, header)

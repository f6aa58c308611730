"""Line-first quality rules, with DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate), the
failing lines are taken out, and a document is rejected if its base measures
fail or too much of it was taken out.  One scan, no shuffle, no Python.

Defined cases: a null or empty text has no words, so its base rule fails; a
blank line is no failure (it is kept and weighs nothing); repeated rows are
judged each by itself; columns other than ``text`` are passed through, and the
added ones replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, aside, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Characters that may close a prose line.
CLOSERS = ".!?:;…\"')”»]"
#: A line that ends openly fails if it has fewer words than this.
SHORT_LINE = 4
#: A document is rejected if its failing lines hold more than this share of its characters.
MAX_LOST_PERCENT = 50
BOILERPLATE = (
    "lorem ipsum",
    "enable javascript",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "click here",
    "sign in to",
    "subscribe to our",
)


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_of(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are among ``chars``."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c for c in chars) + "]"))


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def repeat_words(ws: Column) -> Column:
    """Words that lie in a window of eight words found at least twice.

    Windows are compared by a 64-bit hash of their words.  Most texts have no
    repeated window, which one hash set shows; only the others are sorted.
    """
    n = F.size(ws)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(F.lit(False))
                after = F.when(i + 1 < F.size(s), F.get(s, i + 1)["h"] == x["h"]).otherwise(F.lit(False))
                return before | after

            starts = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
            return F.aggregate(
                starts,
                zero,
                lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["to"])).alias("n"), (p + WINDOW).alias("to")),
                lambda a: a["n"],
            )

        # a sort by the hash brings twins together
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    each = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(each, lambda w: let(hashes(w), covered)))


def line_fails(line: Column, phrases: Column) -> Column:
    """True if a line with words breaks the punctuation, navigation or boilerplate rule.

    Each rule first asks for what is cheap to see (an open end, one ``!``) and
    counts words only in the few lines that have it; ``phrases`` says whether
    the text has a boilerplate phrase at all.
    """
    n = F.size(F.array_remove(F.split(line, SPACE), ""))
    open_end = F.instr(F.lit(CLOSERS), F.rtrim(line).substr(-1, 1)) == 0
    short = open_end & (n > 0) & (n < SHORT_LINE)
    shouting = line.contains("!") & (n >= SHORT_LINE) & (count_of(line, "!") * 2 >= n)
    menu = line.contains("|") & (count_of(line, "|") >= 2) & (n > 0) & (count_of(line, "|") * 4 >= n)
    symbols = has_any(line, tuple(SYMBOLS)) & (n >= SHORT_LINE) & (count_of(line, SYMBOLS) * 2 >= n)
    return short | shouting | menu | symbols | (phrases & (n > 0) & has_any(F.lower(line), BOILERPLATE))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "chars_removed", "clean_text", "base_failed", "kept", "_ws", "_lines", "_judged"]


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measures, ``clean_text`` (failing lines taken out) and ``kept``.

    Input columns of these names are called ``input_...`` in the result.
    """
    docs, _ = aside(docs, MEASURES)
    t = text_of(F.col(text))
    # bound together, so that a line's lambda never works the phrases out again
    parts = F.struct(F.split(t, "\n").alias("lines"), has_any(F.lower(t), BOILERPLATE).alias("phrases"))
    judged = let(parts, lambda p: F.transform(p["lines"], lambda x: F.struct(x.alias("line"), line_fails(x, p["phrases"]).alias("fails"))))
    staged = docs.withColumns({"_ws": words(F.col(text)), "_lines": F.split(t, "\n"), "_judged": judged})
    with_word = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bad = F.filter("_judged", lambda x: x["fails"])
    out = staged.withColumns(
        {
            "n_words": F.size("_ws").cast("long"),
            "word_chars": F.length(F.array_join("_ws", "")).cast("long"),
            "n_symbols": count_of(t, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_ws")).cast("long"),
            "n_lines_removed": F.size(bad).cast("long"),
            "chars_removed": F.aggregate(bad, F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"])),
            "clean_text": F.array_join(F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
        }
    ).drop("_ws", "_lines", "_judged")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = F.col("chars_removed") * 100 > F.length(t) * MAX_LOST_PERCENT
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The judged documents that are kept.

    A row number between the two keeps the optimizer from moving the filter
    below the measures, where each of them would be worked out again in it.
    """
    return judge(docs, text).withColumn("_at", F.monotonically_increasing_id()).filter("kept").drop("_at")

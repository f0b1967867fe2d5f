"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` counts a text's lengths, symbols, stop words and repeated lines; ``THRESHOLDS`` bounds
their ratios; ``verdict`` compiles the table into one boolean column. Everything is built-in, so the
plan is scan and projections: no exchange, and no state beyond one row.

Defined results: a null text counts as empty; an empty text fails the base rule. Rows are judged
one by one, so ties, repeated rows and null ids keep their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import WORD, word_column

SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or from at which but have an they you were "
    "der die und das von den mit ist des im dem nicht ein eine als auch es an werden aus er sich auf "
    "de la que el en y los se del las un por con no una su para al lo como esos "
    "le les et des du dans qui par sur au pour est une ce pas plus sont il elle avec"
).split()


@dataclass(frozen=True)
class Threshold:
    """A ratio of two measures that a clean text keeps within bounds."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


THRESHOLDS = (
    Threshold("length", "n_words", None, 50, 1_000_000),
    Threshold("word_length", "word_chars", "n_words", 2.0, 15.0),
    Threshold("symbols", "n_symbols", "n_words", None, 0.1),
    Threshold("exclamations", "n_exclamations", "n_words", None, 0.3),
    Threshold("stop_words", "n_stop_words", "n_words", 0.05, None),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the counts that the rules read.

    The projections are kept apart so that the words are taken from a text once.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), word_column(F.col("text")).alias("words"))
    has_word = lambda line: line.rlike(WORD)
    rows = rows.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.filter(F.split("text", "\n"), has_word).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    three = F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    rows = rows.withColumn("windows", F.slice(three, 1, F.greatest(F.size("hashes") - 2, F.lit(0)))).drop("hashes")
    return rows.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_exclamations",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _covered_by_repeats("windows").alias("n_repeat_words"),
    )


#: Bits of a packed window that hold its place; texts of more words go the way of unpacked ones.
PLACE_BITS = 20


def _covered_by_repeats(windows: str) -> Column:
    """Words in 3-word windows that are found twice or more: sort the windows, keep those with an equal neighbour.

    A window's hash and place are packed into one long, which sorts fast; neighbours that agree in the
    packed bits are compared by their whole hashes. A text without any repeat is known by its distinct
    windows and needs no sort.
    """
    low = (1 << PLACE_BITS) - 1
    all_windows = F.col(windows)
    size = F.size(windows)
    place = lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int")
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~low).cast("long")).bitwiseOR(i.cast("long"))))

    def equal(x: Column, y: Column) -> Column:
        near = F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
        return F.coalesce(near & (F.get(all_windows, place(x)) == F.get(all_windows, place(y))), F.lit(False))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    count = lambda items, equal, where: F.size(F.array_distinct(_words_of_twins(items, equal, where))).cast("long")
    short = count(packed, equal, place)
    return F.when(F.size(F.array_distinct(windows)) == size, F.lit(0).cast("long")).when(size < low, short).otherwise(count(placed, same, lambda x: x["i"]))


def _words_of_twins(items: Column, equal, where) -> Column:
    """The words of the windows in ``items``, which are sorted, that equal a neighbour."""
    twins = lambda all_: F.filter(all_, lambda x, i: equal(F.get(all_, i - 1), x) | equal(x, F.get(all_, i + 1)))
    words = lambda x: F.array(where(x), where(x) + 1, where(x) + 2)
    # the sorted array is bound once, as the only element of an array that a lambda walks
    return F.flatten(F.transform(F.array(items), lambda all_: F.flatten(F.transform(twins(all_), words))))


def verdict(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The table as one boolean column; a ratio over nothing passes."""
    passed = F.lit(True)
    for rule in thresholds:
        value = F.col(rule.numerator).cast("double")
        if rule.denominator:
            value = F.when(F.col(rule.denominator) > 0, value / F.col(rule.denominator))
        for bound, kept in ((rule.low, lambda v, b: v >= b), (rule.high, lambda v, b: v <= b)):
            if bound is not None:
                passed = passed & F.coalesce(kept(value, F.lit(float(bound))), F.lit(True))
    return passed


def quality_report(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, for every whole text."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = measures(docs).withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(thresholds)).alias("kept"), "n_stop_words", "n_lines", "n_exclamations"
    )

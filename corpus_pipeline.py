"""A training corpus from raw documents: five stages, each one operator.

Every stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, mixing, ngram_join, packing, substring
from loomgraph.plans.scratch import Scratch

#: A text stays if this share of its words is in learned languages, whichever. Mixed texts stay.
LEAST_SHARE = 0.4
#: SQL can't express the model of the first stage or the tokens of the last.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are in no language: without a letter, or with less than LEAST_SHARE of the words in learned languages.

    Texts are judged where they are scanned, and the other columns travel with them under names
    that clash with nothing: no join by id. Rows are judged one by one: repeated rows and null ids
    stay if their text does; null and empty texts go; no rows, or none with a label, leave none.
    """
    model = langid.train(docs)
    names = {c: c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    found = langid.identify(rows, model, carried=tuple(names.values()), with_spans=False)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("learned") >= LEAST_SHARE))
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Of rows that repeat it one stays (``ngram_join.keep_one`` says which); rows with a null id or
    without a word are in no group and stay. No rows give no rows.
    """
    return ngram_join.keep_one(docs, Scratch(spark))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that an earlier document has; n_chars follows the text.

    Every row stays, one whose text is all repeated with an empty text. Rows with a null id, null texts
    and texts of fewer than 50 words are left as they are. No rows give no rows.
    """
    stripped = substring.strip_repeats(docs, Scratch(spark))
    return stripped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else stripped


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its target.

    A null source is a source; texts without a word have no size and are taken 0 times; equal rows
    are taken together or not at all. No rows give no rows.
    """
    return mixing.repeat_rows(docs, Scratch(spark))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document's tokens into sequences; a document that the mix repeats is packed as often.

    A null or empty text is its end id. No rows give no rows.
    """
    return packing.pack(docs, Scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mixture", mixture),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs

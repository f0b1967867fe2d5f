"""The queries of this subpackage, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import embedding, html_extract, langid, mixing, ngram_join, packing, quality, substring, url_filter, warc
from loomgraph.llm.oracles import QUALITY_SQL
from loomgraph.plans.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), Scratch(spark))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), Scratch(spark))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), Scratch(spark))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_documents(_table(spark, sf_dir, "documents"), Scratch(spark))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_report(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"), Scratch(spark))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_html_extraction": op10_html_extraction,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.FILTER_SQL,
    "op3_mixing": mixing.MIX_SQL,
    "op4_warc": warc.WARC_SQL,
    "op5_substring_dedup": substring.SUBSTRING_SQL,
    "op6_ngram_jaccard_join": ngram_join.JOIN_SQL,
    "op7_quality_rules": QUALITY_SQL,
    "op9_embedding_near_dedup": embedding.NEAR_SQL,
}

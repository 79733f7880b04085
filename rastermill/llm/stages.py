"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents that stay.

Each stands null, empty and very long texts, null ids and sources, ties, repeated rows, empty tables and
further columns of any name as its operator says; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import language_id, line_dedup, mixing, near_dedup, packing
from rastermill.llm.queries import default_tokenizer


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or without a language that has half of their
    words, go. With no labelled document at all every document goes, for no language is known."""
    training = docs.where(~F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False)))
    return language_id.filter_identified(docs, training, least_share=0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; documents stay, null texts become empty,
    and n_chars is counted again. Each repeated row is a document."""
    kept = line_dedup.drop_frequent_lines(docs, min_documents=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id; texts without words
    are no copies of each other and stay, but of equal rows one."""
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, in whole documents; those without words go."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs.select("doc_id", "text"), default_tokenizer())

"""A corpus pipeline over the documents table; STAGES are applied in order, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastermill.llm import stages
from rastermill.llm.common import Scratch

STAGES = [
    ("language_id", stages.keep_identified),
    ("line_dedup", stages.drop_lines),
    ("near_dedup", stages.keep_one_of_each),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

# Language mixtures, sketches and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs

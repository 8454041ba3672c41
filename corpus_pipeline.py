"""The corpus pipeline: language ID, exact dedup, near dedup, source mix and packing.

Every stage takes null or repeated ids, null and empty texts, empty tables and extra columns of any
name. Texts that are null or have no letters go in the first stage, which also rejects documents
whose language the model cannot tell; the two dedup stages keep one row of each group; the mix
repeats or leaves out rows; the last stage returns pieces of documents in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, langid, mixing, neardup, packing
from tidemark.llm.common import Scratch
from tidemark.llm.queries import tokenizer_file


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those whose predicted language is less likely than not."""
    return langid.identified_documents(docs)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_each(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language ID", keep_identified),
    ("exact dedup", remove_exact_copies),
    ("MinHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' sampling and packing are not SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        # A stage's own tables go once its output is written, and its input with them.
        with Scratch(spark, "pipeline-stage"):
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs

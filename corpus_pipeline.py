"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokenising; each stage reads what the last one kept.

All stages but the last keep the columns of documents. Empty and null texts are kept or dropped by the stages' own rules
(see their modules); an empty table goes through. Very long texts pass each stage as one row; of ties and repeated rows one
stays; further columns go through under their own names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import exact_dedup, mixing, near_dedup, quality, sentencepieces
from quillsift.llm.common import release, stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and decoded text."""
    return sentencepieces.encode_decode(docs, sentencepieces.model_path(), extra=("token_ids",))


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]
#: The classifier can't be written in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what a stage keeps is written to the shared folder, read again, and then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, former = stored(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        release(former)
    return STAGES[-1][1](spark, docs, sf_dir)

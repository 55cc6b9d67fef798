"""A corpus from documents to a training mix, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import decontaminate, jaccard, lines, mixing, quality
from evenkeel.llm.common import Scratch, durable, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeats(spark, docs, sf_dir)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(spark, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("jaccard_dedup", jaccard_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Hashes of words, a fitted classifier and approximate fingerprints have no counterpart in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def cleaned(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """The documents that all stages before the mix keep.

    Each stage's rows are written to the shared folder and read again as the next one's documents.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, up to the mix's budget: texts as the stages left them, and passes over each."""
    scratch = Scratch(spark)
    out = durable(STAGES[-1][1](spark, cleaned(spark, sf_dir, scratch), sf_dir))
    scratch.close()
    return out

"""Corpus pipeline over ``documents``: one stage per operator, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept, and returns the columns of
``docs``; the last one adds what the mix takes from each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from tastegrid.llm.registry import quoted
from tastegrid.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of a source go out of the texts, long passages from a far smaller part on; ``n_chars`` follows."""
    cut = line_dedup.drop_boilerplate(docs, long_ratio=line_dedup.LONG_RATIO)
    return cut.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: linked are SimHash fingerprints of
    4-word shingles that differ in at most 4 bits."""
    return simhash.keep_first(docs, words=4, radius=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with how many: ``size, source_size, target, taken``."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
]

#: Language models, fingerprints and alignments have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

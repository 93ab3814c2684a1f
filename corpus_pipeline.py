"""The corpus pipeline: rate quality, drop exact and near copies, mix the sources, pack into sequences.

Every stage works on all rows its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelight.llm import exact_dedup, mixing, packing, parity_join, quality
from sourcelight.llm.common import saved, table
from sourcelight.llm.queries import tokenizer_files


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote accepts (score of 0.7 or more)."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text, the one with the largest doc_id."""
    return exact_dedup.keep_one_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return parity_join.keep_one_of_each_group(docs, parity_join.Likeness(words=5, num=80, den=100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again, at most 1.25 times on average per source."""
    return mixing.mixed_documents(docs, max_repetition=1.25)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1,024 tokens."""
    return packing.pack_documents(docs, tokenizer_files())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Neighbour voting and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

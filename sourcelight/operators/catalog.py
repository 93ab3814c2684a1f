"""Document catalogue and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def document_summaries(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document rows with section and chunk counts; zero without chunks."""
    fields = [
        c
        for c in (
            "document_id", "title", "category", "source_path", "status", "error", "version", "effective_date",
            "department", "owner",
        )
        if c in documents.columns
    ]
    return (
        documents.select(*fields, F.size(X.section_titles(F.col("content"))).alias("section_count"))
        .join(chunk_counts(chunks), "document_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    )


def health(errors: Column, has_index: Column) -> Column:
    """degraded with errors, starting without an index, else ok."""
    return F.when(errors > 0, F.lit("degraded")).when(~has_index, F.lit("starting")).otherwise(F.lit("ok"))


def status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts and the three-state health of the corpus.

    Failing documents are listed by :func:`document_errors`, not gathered here.
    """
    failed = (F.col("status") != "ready") & (F.coalesce("error", F.lit("")) != "")
    docs = documents.agg(
        F.count("*").alias("document_count"),
        F.coalesce(F.sum((F.col("status") == "ready").cast("int")), F.lit(0)).alias("ready_document_count"),
        F.coalesce(F.sum(failed.cast("int")), F.lit(0)).alias("error_count"),
    ).withColumn("_one", F.lit(1))
    counted = chunks.agg(F.count("*").alias("chunk_count")).withColumn("_one", F.lit(1))
    return (
        docs.join(counted, "_one")
        .drop("_one")
        .withColumn("health", health(F.col("error_count"), F.col("chunk_count") > 0))
    )


def document_errors(documents: DataFrame) -> DataFrame:
    return documents.where((F.col("status") != "ready") & (F.coalesce("error", F.lit("")) != "")).select(
        "source_path", "error"
    )

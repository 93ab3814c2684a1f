"""The given tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.operators.chunking import split_documents
from sourcelight.settings import DEFAULT_SETTINGS, Settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that has fewer partitions than there are cores, dealt out to all of them.

    A table of one row group cannot be split by its scan, whatever the compute
    cost. A scan of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out to all cores before costly work, however few row groups hold them.

    A scan may have many partitions of which one holds all rows, so their number does not tell.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as knowledge documents; ``doc_id`` becomes a string id."""
    raw = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    key = F.col("doc_id").cast("string")
    return (
        raw.select(
            key.alias("document_id"),
            F.col("lang").alias("category"),
            F.concat_ws("", F.col("source"), F.lit("/"), key, F.lit(".txt")).alias("source_path"),
            F.col("source").alias("department"),
            X.normalize_text(F.coalesce("text", F.lit(""))).alias("content"),
            X.has_text(F.coalesce("text", F.lit(""))).alias("_ok"),
        )
        .withColumn("heading", X.heading_title(F.col("content")))
        .withColumn("title", F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("document_id")))
        .withColumn("status", F.when(F.col("_ok"), "ready").otherwise("error"))
        .withColumn("knowledge_base_id", F.lit("policy"))
        .drop("heading", "_ok")
    )


def chunks(spark: SparkSession, sf_dir: str, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    return split_documents(documents(spark, sf_dir), settings)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )

"""Running feedback summary over a stream of feedback rows (an extension).

The batch summary is a plain aggregate, so the same transform keeps a running
total over appended files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.sources.stores import FEEDBACK_SCHEMA


def read_feedback(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK_SCHEMA).options(**options).parquet(path)


def running_counts(rows: DataFrame) -> DataFrame:
    """Counts per (rating, reason), updated with every micro-batch.

    State is one row per distinct pair, independent of the number of records.
    """
    return rows.groupBy("rating", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def start(rows: DataFrame, checkpoint: str, name: str = "feedback_summary"):
    return (
        running_counts(rows)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Spark session construction and a small plan helper."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "sourcelight", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the few settings the transforms rely on.

    Everything else (shuffle width, executor memory, broadcast threshold) is
    left to the cluster; AQE sizes shuffle partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def fenced(df: DataFrame, *keys: str) -> DataFrame:
    """Compute a per-question table once and spread it by key.

    Without an exchange the optimizer copies a column's expression into every
    lambda that reads it, where it runs once per array element. The width is the
    session's, so adaptive execution may change it.
    """
    return df.repartition(*keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sourcelight-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, path: str = "", label: str = "table", **options: str) -> DataFrame:
    """Write a table once, to ``path`` or a new place in the shared folder, and read it back.

    What is read survives lost executors, and its size is known, so a later join
    sends it to all tasks only below the session's threshold.
    """
    path = path or f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

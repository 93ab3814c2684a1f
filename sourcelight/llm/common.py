"""Shared folder, saved tables and small column helpers of the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    Only a session that names none (a local test) gets one of its own.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sourcelight-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table once into the shared folder and read it back: cuts lineage, survives lost executors.

    The optimizer then knows its size, so a later join is broadcast only if the
    written files are below the session's threshold.
    """
    path = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def salt(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def salts(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (one column, null matches null); columns as they were.

    A merge join at every size: the list grows with the corpus.
    """
    gone = ids.toDF("_gone_id").hint("merge")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]), "left_anti")

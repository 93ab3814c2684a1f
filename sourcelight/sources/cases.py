"""JSON case files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION_SCHEMA = (
    "case_id string, question string, expected_source string, expected_keywords array<string>, "
    "should_refuse boolean, notes string"
)
_EXPECTATION = "struct<expected:string,keywords:array<string>,may_vary:boolean>"
QUALITY_SCHEMA = (
    f"case_id string, question string, with_adaptation {_EXPECTATION}, without_adaptation {_EXPECTATION}, notes string"
)
ACCEPTANCE_SCHEMA = "id string, question string, required string, exclude string, source string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def evaluation_cases(spark: SparkSession, directory: str) -> DataFrame:
    """All ``*.json`` arrays of a folder; missing fields and repeated ids are errors."""
    raw = _read(spark, f"{directory}/*.json", EVALUATION_SCHEMA)
    refuse = F.coalesce("should_refuse", F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = raw.select(
        "case_id",
        "question",
        F.coalesce("expected_source", F.lit("")).alias("expected_source"),
        F.coalesce("expected_keywords", F.array().cast("array<string>")).alias("expected_keywords"),
        refuse.alias("should_refuse"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        (blank("case_id") | blank("question") | (blank("expected_source") & ~refuse)).alias("_bad"),
    )
    # Case sets are small; both checks are one aggregate each.
    bad = rows.where("_bad").select("case_id").take(1)
    if bad:
        raise ValueError(f"evaluation case lacks required fields: {bad[0]['case_id']}")
    check_unique(rows, "case_id")
    return rows.drop("_bad").orderBy("case_id")


def check_unique(rows: DataFrame, key: str) -> None:
    repeated = rows.groupBy(key).count().where("count > 1").select(key).take(1)
    if repeated:
        raise ValueError(f"repeated {key}: {repeated[0][0]}")


def answer_quality_cases(spark: SparkSession, path: str) -> DataFrame:
    """Answer-quality cases; a missing file gives no rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], QUALITY_SCHEMA)
    return _read(spark, path, QUALITY_SCHEMA).withColumn("notes", F.coalesce("notes", F.lit("")))


def acceptance_cases(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ACCEPTANCE_SCHEMA)


def write_audit(answers: DataFrame, cases: DataFrame, path: str) -> None:
    """Answers beside their cases for a manual audit; nothing is scored."""
    cases.join(answers, cases["id"] == answers["query_id"], "left").drop("query_id").write.mode("overwrite").json(path)

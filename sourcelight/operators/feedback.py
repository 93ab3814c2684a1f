"""User feedback: validation and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.rules import vocabulary as V


def _require(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def normalize_feedback(rows: DataFrame) -> DataFrame:
    """Validated records; a positive rating carries no reason."""
    question, answer = X.strip(F.col("question")), X.strip(F.col("answer"))
    rating = F.coalesce("rating", F.lit(""))
    reason = F.coalesce("reason", F.lit(""))
    return rows.select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("feedback_id"),
        _require(
            F.length(question).between(1, V.QUESTION_LIMIT), "question must not be blank or too long", question
        ).alias("question"),
        _require(F.length(answer).between(1, V.ANSWER_LIMIT), "answer must not be blank or too long", answer).alias("answer"),
        _require(rating.isin(*V.RATINGS), "rating must be up or down", rating).alias("rating"),
        F.when(rating == "up", F.lit(""))
        .otherwise(_require(reason.isin("", *V.FEEDBACK_REASONS), "unknown reason", reason))
        .alias("reason"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
    )


def summarize_feedback(rows: DataFrame, unresolved: str = V.UNRESOLVED_REASON) -> DataFrame:
    """One row: totals per rating, reason histogram, unresolved count.

    Reasons are counted first (map-side combined), so the final gather holds
    one entry per distinct reason and rating.
    """
    counted = rows.groupBy("rating", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
    per_reason = counted.groupBy("reason").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("rating") == "up", F.col("n")).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("rating") == "down", F.col("n")).otherwise(0)).alias("down"),
    )

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    named = F.when(F.col("reason") != "", F.struct("reason", "n"))
    return per_reason.agg(
        total(F.col("n")).alias("total"),
        total(F.col("up")).alias("up"),
        total(F.col("down")).alias("down"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("reasons"),
        total(F.when(F.col("reason") == unresolved, F.col("n"))).alias("unresolved"),
    )

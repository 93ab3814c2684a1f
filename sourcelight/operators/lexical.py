"""BM25 statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.settings import DEFAULT_SETTINGS, Settings


def with_tokens(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("tokens", X.tokens(F.col(text)))


def term_frequencies(tokenized: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf); partial counts are complete before the shuffle."""
    return (
        tokenized.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    )


def document_frequencies(tokenized: DataFrame) -> DataFrame:
    """(term, df). Distinct terms are taken inside the row, so one shuffle on a
    map-side combined count is enough, however common a term is."""
    return (
        tokenized.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def corpus_size(tokenized: DataFrame) -> DataFrame:
    """One row: number of texts and mean length, empty texts included."""
    return tokenized.agg(
        F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_len")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, length: Column, avg_len: float, settings: Settings = DEFAULT_SETTINGS) -> Column:
    k1, b = settings.bm25_k1, settings.bm25_b
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / F.lit(avg_len or 1.0))
    return tf * F.lit(k1 + 1.0) / (tf + norm)

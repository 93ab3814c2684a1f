"""Role-based visibility, applied before any statistics or ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.operators.retrieval import hybrid
from sourcelight.rules import vocabulary as V
from sourcelight.settings import DEFAULT_SETTINGS, Settings


def check_role(role: str) -> str:
    if role not in V.ROLES:
        raise ValueError(f"role must be one of {', '.join(V.ROLES)}")
    return role


def visible(role: str, allowed: Column) -> Column:
    check_role(role)
    return F.lit(True) if role == "admin" else F.array_contains(allowed, role)


def attach_roles(documents: DataFrame, acl: DataFrame) -> DataFrame:
    """Add ``allowed_roles`` from (source_path, allowed_roles); legal by default."""
    default = X.literal_array(V.DEFAULT_CONTRACT_ROLES)
    granted = acl.select("source_path", F.col("allowed_roles").alias("_granted"))
    return (
        documents.drop("allowed_roles")
        .join(granted, "source_path", "left")
        .withColumn("allowed_roles", F.coalesce("_granted", default))
        .drop("_granted")
    )


def visible_documents(documents: DataFrame, role: str) -> DataFrame:
    return documents.where(visible(role, F.col("allowed_roles")))


def list_contracts(documents: DataFrame, role: str) -> DataFrame:
    return visible_documents(documents, role).select(
        "document_id",
        "title",
        "knowledge_base_id",
        "status",
        "allowed_roles",
        X.content_version(F.col("content")).alias("document_version"),
    )


def contract_preview(chunks: DataFrame, document_id: str, limit: int) -> DataFrame:
    """First chunks of one contract, for a review without a query."""
    return chunks.where((F.col("document_id") == document_id) & (F.col("chunk_index") < limit))


def contract_search(
    chunks: DataFrame, document_id: str, query: str, settings: Settings = DEFAULT_SETTINGS
) -> DataFrame:
    """Ranked chunks of one authorised contract; statistics come from it alone."""
    own = chunks.where(F.col("document_id") == document_id)
    asked = chunks.sparkSession.createDataFrame([("q", query)], "query_id string, question string")
    return hybrid(own, asked, settings, top_k=settings.answer_top_k)


def related_policy(rows: DataFrame, gated: DataFrame) -> DataFrame:
    """Policy chunks beside a contract review, only where evidence suffices."""
    enough = gated.where(F.col("best_document").isNotNull()).select("query_id")
    return rows.where(F.col("knowledge_base_id") == "policy").join(enough, "query_id", "left_semi")

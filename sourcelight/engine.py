"""One object over the transforms: index, answers, contracts, evaluation, feedback."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.operators import access, catalog, clauses, conversation, evaluation, evidence, feedback, retrieval
from sourcelight.operators.chunking import split_documents
from sourcelight.rules.vocabulary import DEFAULT_VOCABULARY, Vocabulary
from sourcelight.settings import DEFAULT_SETTINGS, Settings
from sourcelight.sources import files, stores


class Engine:
    """Batch counterparts of every service call; all results are DataFrames."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        settings: Settings = DEFAULT_SETTINGS,
        vocabulary: Vocabulary = DEFAULT_VOCABULARY,
        embed: Callable | None = None,
        rerank: Callable | None = None,
        generate: Callable | None = None,
        pdf_parser: files.PdfParser | None = None,
    ) -> None:
        self.spark, self.settings, self.vocabulary = spark, settings, vocabulary
        self.rerank, self.generate, self.pdf_parser = rerank, generate, pdf_parser
        root = folder.rstrip("/")
        self.index = stores.IndexStore(spark, f"{root}/index", settings, embed)
        self.feedback = stores.FeedbackStore(spark, f"{root}/feedback")
        self.permissions = stores.PermissionStore(spark, f"{root}/permissions")
        self.contract_path = f"{root}/contracts"

    # --- knowledge base ---
    def rebuild(self, directory: str, force: bool = False) -> dict:
        """Bring the index to the folder's files; only new and changed ones are parsed."""
        listed = files.list_files(self.spark, directory)
        return self.index.refresh(listed, lambda new: files.parse_files(new, pdf_parser=self.pdf_parser), force)

    def documents(self) -> DataFrame:
        return catalog.document_summaries(self.index.documents(), self.index.chunks())

    def status(self) -> DataFrame:
        return catalog.status(self.index.documents(), self.index.chunks())

    def ask(self, questions: DataFrame, extractive: bool = True) -> DataFrame:
        return conversation.ask(
            self.index.search_index(), self.index.documents(), conversation.check_requests(questions), self.settings, self.vocabulary, self.generate,
            extractive, self.index.search_embedding(), self.rerank,
        )

    def search(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        return retrieval.hybrid(
            self.index.search_index(), questions, self.settings, top_k, self.index.search_embedding(), self.rerank
        )

    # --- evaluation ---
    def evaluate(self, cases: DataFrame) -> DataFrame:
        """Per-case rows; summarise them with ``evaluation.summarize``."""
        asked = cases.select(F.col("case_id").alias("query_id"), "question")
        rows = self.search(asked, top_k=10)
        results = retrieval.collect_results(rows)
        empty = F.array().cast(results.schema["results"].dataType)
        joined = asked.join(results, "query_id", "left").withColumn("results", F.coalesce("results", empty))
        gated = evidence.gate(joined, self.vocabulary, self.settings.adaptations)
        return evaluation.evaluate_cases(cases, rows, self.index.documents(), gated)

    def answer_quality(self, cases: DataFrame) -> DataFrame:
        answers = self.ask(cases.select(F.col("case_id").alias("query_id"), "question"))
        return evaluation.answer_quality_rows(
            cases, answers.select(F.col("query_id").alias("case_id"), "answer"), self.settings.adaptations
        )

    # --- feedback ---
    def record_feedback(self, rows: DataFrame) -> None:
        self.feedback.record(rows)

    def feedback_summary(self) -> DataFrame:
        return feedback.summarize_feedback(self.feedback.read())

    # --- contracts ---
    def contracts(self) -> DataFrame:
        """Uploaded contracts with the roles that the permission table gives them now; without an entry, legal alone."""
        if not files.path_exists(self.spark, self.contract_path):
            return self.spark.createDataFrame([], stores.DOCUMENT_SCHEMA)
        stored = self.spark.read.parquet(self.contract_path)
        return access.attach_roles(stored.drop("allowed_roles"), self.permissions.read())

    def upload_contracts(self, directory: str, actor_role: str, allowed_roles: Sequence[str]) -> None:
        new = files.load_directory(self.spark, directory, "contracts", self.pdf_parser)
        self._accept(new, actor_role, allowed_roles)

    def upload_files(self, uploads: DataFrame, actor_role: str, allowed_roles: Sequence[str]) -> None:
        """Contracts as (filename, content_base64) rows."""
        content = files.decoded_uploads(uploads)
        parsed = files.parse_files(content, "contracts", self.pdf_parser)
        self._accept(files.with_distinct_ids(parsed, content), actor_role, allowed_roles)

    def _accept(self, new: DataFrame, actor_role: str, allowed_roles: Sequence[str]) -> None:
        """Append a batch, then grant its roles; in between only legal sees it."""
        accepted = stores.upload_contracts(new, self.contracts(), actor_role, allowed_roles)
        accepted.write.mode("append").parquet(self.contract_path)
        self.permissions.grant(new.select("source_path"), allowed_roles)

    def list_contracts(self, role: str) -> DataFrame:
        return access.list_contracts(self.contracts(), role)

    def review_contract(self, document_id: str, role: str) -> DataFrame:
        """Review of one visible contract; missing and hidden ones look alike."""
        own = access.visible_documents(self.contracts(), role).where(
            (F.col("document_id") == document_id) & (F.col("status") == "ready")
        )
        if not own.take(1):
            raise KeyError("合同不可用")
        return clauses.review(own)

    def contract_sources(self, document_id: str, role: str, query: str = "") -> DataFrame:
        """Chunks shown beside a review: ranked for a query, else the first few."""
        own = access.visible_documents(self.contracts(), role).where(F.col("document_id") == document_id)
        chunks = split_documents(own.drop("allowed_roles"), self.settings)
        if query.strip():
            return access.contract_search(chunks, document_id, query, self.settings)
        return access.contract_preview(chunks, document_id, self.settings.answer_top_k)

    def related_policy(self, query: str) -> DataFrame:
        asked = self.spark.createDataFrame([("q", query)], "query_id string, question string")
        rows = self.search(asked, self.settings.answer_top_k)
        joined = asked.join(retrieval.collect_results(rows), "query_id")
        return access.related_policy(rows, evidence.gate(joined, self.vocabulary, self.settings.adaptations))

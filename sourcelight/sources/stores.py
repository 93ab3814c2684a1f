"""Stored tables: retrieval index, feedback, contract permissions, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.functions.hashing import count_vectors
from sourcelight.operators import cells, postings
from sourcelight.operators.access import check_role
from sourcelight.operators.chunking import split_documents
from sourcelight.operators.feedback import normalize_feedback
from sourcelight.operators.retrieval import SearchIndex, chunk_columns, prepare_chunks
from sourcelight.operators.vectors import embed_column
from sourcelight.rules import vocabulary as V
from sourcelight.session import stored
from sourcelight.settings import DEFAULT_SETTINGS, Settings
from sourcelight.sources.files import file_digests, fingerprint, named_files, path_exists

INDEX_VERSION = 3
DOCUMENT_SCHEMA = (
    "document_id string, title string, category string, source_path string, content string, sections array<string>, "
    "status string, error string, version string, effective_date string, department string, owner string, "
    "knowledge_base_id string, allowed_roles array<string>"
)
FEEDBACK_SCHEMA = "feedback_id string, question string, answer string, rating string, reason string, created_at string"
ACL_SCHEMA = "source_path string, allowed_roles array<string>"


MAX_SEGMENTS = 8


class IndexStore:
    """Documents, chunks, postings and vectors as Parquet tables, in segments.

    A build compares digests of the files with those of the stored ones, parses
    only new and changed files, and writes them as one more segment; unchanged
    files stay where they are. A segment that holds a removed or changed file is
    written again from its stored documents, without parsing, and so are all of
    them once there are more than ``MAX_SEGMENTS``. An unchanged corpus writes
    nothing. Readers take the union of the segments that the newest metadata row
    names; it is appended last, so a failed build leaves the previous one in use.

    A plug-in embedding is called once for each new chunk; if it fails there,
    feature-hash vectors serve the segment instead, and searches use the plug-in
    only if all segments have its vectors.
    """

    def __init__(
        self, spark: SparkSession, folder: str, settings: Settings = DEFAULT_SETTINGS, embed: Callable | None = None
    ) -> None:
        self.spark, self.folder, self.settings, self.embed = spark, folder.rstrip("/"), settings, embed

    def settings_key(self) -> str:
        s = self.settings
        plugged = ":plugged" if self.embed is not None else ""
        return f"{INDEX_VERSION}:{s.chunk_size}:{s.chunk_overlap}:{s.vector_mode}:{s.hash_dim}{plugged}"

    def search_embedding(self) -> Callable | None:
        """The plug-in if the stored vectors are its own."""
        meta = self.metadata()
        return self.embed if meta and meta["effective_embedding_provider"] == "plugged" else None

    def metadata(self) -> dict | None:
        """The newest build's row, or None before the first build. A table that cannot be read is an error."""
        if not path_exists(self.spark, f"{self.folder}/metadata"):
            return None
        newest = self.spark.read.parquet(f"{self.folder}/metadata").orderBy(F.desc("built_at"), F.desc("build")).first()
        return newest.asDict() if newest else None

    def exists(self) -> bool:
        return self.metadata() is not None

    # --- building ---
    def build(self, documents: DataFrame, force: bool = False) -> dict:
        """Bring the index to these parsed documents; a document counts as unchanged if all its fields do."""
        row = F.sha2(F.to_json(F.struct(*sorted(documents.columns))), 256)
        now = documents.select("source_path", "document_id", row.alias("digest"))
        return self._refresh(now, lambda new: documents.join(new.select("source_path"), "source_path", "left_semi"), force)

    def refresh(self, files: DataFrame, parse: Callable[[DataFrame], DataFrame], force: bool = False) -> dict:
        """Bring the index to these (path, content) files; only new and changed ones are given to ``parse``."""

        def load(new: DataFrame) -> DataFrame:
            names = new.select("source_path", F.col("document_id").alias("_id"))
            named = named_files(files)
            wanted = named.join(names, "source_path", "left_semi").select("path", "content")
            parsed = parse(wanted).join(names, "source_path").withColumn("document_id", F.col("_id")).drop("_id")
            return parsed.drop("suffix")

        return self._refresh(file_digests(files), load, force)

    def _refresh(self, now: DataFrame, load: Callable[[DataFrame], DataFrame], force: bool) -> dict:
        told = now.select("source_path", F.concat_ws(":", "document_id", "digest").alias("content"))
        digest = fingerprint(told, self.settings_key()).first()["fingerprint"]
        current = self.metadata()
        if current and current["fingerprint"] == digest and not force:
            return current
        reuse = current and not force and current["settings_key"] == self.settings_key()
        segments = list(current["segments"]) if reuse else []
        built = f"build-{uuid.uuid4().hex}"
        now = stored(now, f"{self.folder}/{built}/now")
        key = ["source_path", "document_id", "digest"]
        parts = [self.spark.read.parquet(f"{self.folder}/{s}/files").withColumn("_in", F.lit(s)) for s in segments]
        fresh, dirty = now, []
        if parts:
            old = reduce(DataFrame.unionByName, parts)
            fresh = now.join(old, key, "left_anti")
            dirty = [r["_in"] for r in old.join(now, key, "left_anti").select("_in").distinct().collect()]
        if len(segments) - len(dirty) + 1 > MAX_SEGMENTS:
            dirty = segments
        documents = load(fresh)
        for s in dirty:
            kept = self.spark.read.parquet(f"{self.folder}/{s}/files").join(now, key, "left_semi")
            held = self.spark.read.parquet(f"{self.folder}/{s}/documents")
            documents = documents.unionByName(held.join(kept.select("source_path"), "source_path", "left_semi"))
        taken = {self._figures(s)["slot"] for s in segments}
        slot = min(set(range(len(taken) + 1)) - taken)  # chunk numbers of live segments never meet
        figures = self._write_segment(built, documents, slot)
        moved = self.spark.read.parquet(f"{self.folder}/{built}/documents").select("source_path")
        now.join(moved, "source_path", "left_semi").write.parquet(f"{self.folder}/{built}/files")
        names = [*(s for s in segments if s not in dirty), built]
        all_figures = [self._figures(s) for s in names[:-1]] + [figures]
        if not sum(f["chunk_count"] for f in all_figures):
            raise ValueError("no document content to index")
        providers = {f["provider"] for f in all_figures if f["chunk_count"]}
        row = {
            "fingerprint": digest,
            "build": built,
            "settings_key": self.settings_key(),
            "segments": names,
            "document_count": sum(f["document_count"] for f in all_figures),
            "chunk_count": sum(f["chunk_count"] for f in all_figures),
            "dimension": max(f["dimension"] for f in all_figures),
            "effective_embedding_provider": providers.pop() if len(providers) == 1 else "mixed",
            "embedding_error": next((f["error"] for f in all_figures if f["error"]), ""),
        }
        if row["effective_embedding_provider"] == "mixed":  # a plug-in that failed for one segment: hash vectors for all
            return self._without_plugin().build(self.documents_of(names), force=True)
        made = self.spark.createDataFrame([row]).withColumn("built_at", F.current_timestamp())
        made.coalesce(1).write.mode("append").parquet(f"{self.folder}/metadata")
        return self.metadata()

    def _without_plugin(self) -> IndexStore:
        return IndexStore(self.spark, self.folder, self.settings)

    def documents_of(self, segments: Sequence[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{s}/documents") for s in segments])

    def _figures(self, segment: str) -> dict:
        return self.spark.read.parquet(f"{self.folder}/{segment}/figures").first().asDict()

    def _write_segment(self, segment: str, documents: DataFrame, slot: int) -> dict:
        base = f"{self.folder}/{segment}"
        parsed = stored(documents, f"{base}/documents")
        placed = postings.numbered(prepare_chunks(split_documents(parsed, self.settings)), slot)
        provider, error = "local" if self.settings.vector_mode == "hash" else "bm25_only", ""
        if self.embed is not None:
            try:
                embedded = placed.withColumn("vector", embed_column(self.embed)("content"))
                embedded.write.partitionBy("knowledge_base_id").parquet(f"{base}/chunks-plugged")
                provider = "plugged"
            except PySparkException as exc:  # the plug-in failed in a task
                error = type(exc).__name__
        name = "chunks-plugged" if provider == "plugged" else "chunks"
        if provider != "plugged":
            placed.write.partitionBy("knowledge_base_id").parquet(f"{base}/{name}")
        chunks = self.spark.read.schema(placed.schema if provider != "plugged" else embedded.schema).parquet(f"{base}/{name}")
        texts, words = postings.lexical_figures(chunks)
        mean = words / texts if texts else 0.0
        postings.store_packed(postings.packed_of(chunks, mean, self.settings), f"{base}/postings")
        dimension = 0
        if provider != "bm25_only":
            own = [*cells.KEYS, "knowledge_base_id"]

            def vectors_of(rows: DataFrame) -> DataFrame:
                if provider == "plugged":
                    return rows.select(*own, "vector")
                return count_vectors(rows.select(*own, "tokens", "squeezed"), self.settings.hash_dim)

            made = cells.build_cells(chunks, f"{base}/vectors", ("knowledge_base_id",), vectors_of)
            told = [(i, [float(x) for x in p]) for i, p in enumerate(made.pivots)]
            self.spark.createDataFrame(told, "cell int, pivot array<double>").coalesce(1).write.parquet(f"{base}/pivots")
            dimension = made.pivots.shape[1]
        figures = {
            "chunk_table": name, "provider": provider, "error": error, "mean_len": float(mean), "dimension": dimension,
            "document_count": parsed.count(), "chunk_count": texts, "slot": slot,
        }
        self.spark.createDataFrame([figures]).coalesce(1).write.parquet(f"{base}/figures")
        return figures

    # --- reading ---
    def _tables(self, name: str) -> DataFrame:
        """The union of one table over all segments."""
        meta = self.metadata()
        if meta is None:
            raise ValueError("the index has not been built")
        paths = [f"{self.folder}/{s}/{name or self._figures(s)['chunk_table']}" for s in meta["segments"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(p) for p in paths])

    def documents(self) -> DataFrame:
        return self._tables("documents")

    def chunks(self, knowledge_base_id: str = "policy") -> DataFrame:
        """Chunks as ``split_documents`` gives them."""
        held = self._tables("").where(F.col("knowledge_base_id") == knowledge_base_id)
        return held.select(*chunk_columns(held))

    def vectors(self, expected_fingerprint: str | None = None) -> DataFrame:
        """Stored vectors after checking count, size and fingerprint."""
        meta = self.metadata()
        table = self._tables("vectors")
        figures = table.agg(
            F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")
        ).first()
        if figures["n"] != meta["chunk_count"] or {figures["low"], figures["high"]} != {meta["dimension"]}:
            raise ValueError("vectors do not match their metadata")
        if expected_fingerprint is not None and meta["fingerprint"] != expected_fingerprint:
            raise ValueError("vectors do not match the corpus fingerprint")
        return table

    def search_index(self, knowledge_base_id: str = "policy") -> SearchIndex:
        """What a search reads: stored chunks, postings, and cells of vectors. Nothing is tokenised or hashed anew."""
        own = F.col("knowledge_base_id") == knowledge_base_id
        meta = self.metadata()
        held = self._tables("").where(own)
        texts, words = postings.lexical_figures(held)
        means = [f["mean_len"] for f in map(self._figures, meta["segments"]) if f["chunk_count"]]
        lexical = postings.LexicalIndex(
            held, self._tables("postings").where(own), texts, words, min(means, default=0.0)
        )
        if meta["effective_embedding_provider"] == "bm25_only":
            return SearchIndex(lexical)
        parts = []
        for s in meta["segments"]:
            pivots = self.spark.read.parquet(f"{self.folder}/{s}/pivots").orderBy("cell").collect()
            matrix = np.array([r["pivot"] for r in pivots], dtype=float).reshape(-1, meta["dimension"])
            parts.append(cells.opened_cells(self.spark.read.parquet(f"{self.folder}/{s}/vectors").where(own), matrix))
        index = cells.merged(parts)
        if sum(index.rows) != texts:
            raise ValueError("vectors do not match their metadata")
        return SearchIndex(lexical, index)


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents; fields added later default as for new documents."""
    raw = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    empty = F.array().cast("array<string>")
    text = {c: F.coalesce(c, F.lit("")) for c in ("error", "version", "effective_date", "department", "owner")}
    return raw.withColumns(
        {
            **text,
            "status": F.coalesce("status", F.lit("ready")),
            "knowledge_base_id": F.coalesce("knowledge_base_id", F.lit("policy")),
            "sections": F.coalesce("sections", empty),
            "allowed_roles": F.coalesce("allowed_roles", empty),
        }
    )


class FeedbackStore:
    """Append-only feedback table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def record(self, rows: DataFrame) -> None:
        """Validate and append (question, answer, rating, reason) rows."""
        normalize_feedback(rows).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All records; a table of another structure is refused."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], FEEDBACK_SCHEMA)
        stored = self.spark.read.parquet(self.path)
        told = [(f.name, f.dataType) for f in T.StructType.fromDDL(FEEDBACK_SCHEMA)]
        if [(f.name, f.dataType) for f in stored.schema] != told:
            raise ValueError("feedback table has another structure; it was left unchanged")
        return stored


PERMISSION_SCHEMA = "source_path string, allowed_roles array<string>, version bigint, writer string"


class PermissionStore:
    """Contract permissions as an append-only log: file name, roles, version, writer. Malformed content fails closed.

    The newest version of a name is in force; null roles withdraw it. Writers
    append rows of their own names only, so grants of different files never
    undo each other; of two grants of one name and version the greater writer
    id counts, the same one for every reader.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], PERMISSION_SCHEMA)
        rows = self.spark.read.text(self.path).select(
            F.from_json("value", PERMISSION_SCHEMA, {"mode": "FAILFAST"}).alias("r")
        ).select("r.*")
        roles = F.coalesce(F.forall("allowed_roles", lambda r: r.isNotNull() & r.isin(*V.ROLES)), F.lit(True))
        right = roles & F.col("source_path").isNotNull() & F.col("version").isNotNull() & F.col("writer").isNotNull()
        checked = F.when(right, F.col("version")).otherwise(
            F.raise_error(F.lit("合同权限配置格式无效")).cast("bigint")
        )
        return rows.withColumn("version", checked)

    def newest(self) -> DataFrame:
        """source_path, allowed_roles, version: one row per name; its log combines before the shuffle."""
        latest = F.max(F.struct("version", "writer", "allowed_roles")).alias("m")
        return self.log().groupBy("source_path").agg(latest).select("source_path", "m.allowed_roles", "m.version")

    def read(self) -> DataFrame:
        return self.newest().where(F.col("allowed_roles").isNotNull()).select("source_path", "allowed_roles")

    def append(self, entries: DataFrame, expected: DataFrame | None = None) -> None:
        """Append (source_path, allowed_roles) entries as the next version of each name.

        ``expected`` (source_path, version) are the versions that the caller has
        seen; if a name has moved on since, nothing is written.
        """
        now = self.newest().select("source_path", F.col("version").alias("_now"))
        if expected is not None:
            seen = expected.select("source_path", F.col("version").alias("_seen"))
            if now.join(seen, "source_path").where(F.col("_now") > F.col("_seen")).take(1):
                raise ValueError("the permissions were changed meanwhile; read them again")
        told = entries.join(now, "source_path", "left").select(
            "source_path", "allowed_roles", (F.coalesce("_now", F.lit(0)) + 1).alias("version"), F.lit(uuid.uuid4().hex).alias("writer")
        )
        told.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(self.path)

    def write(self, permissions: dict[str, Sequence[str]]) -> None:
        """Set all permissions: names that are not given lose theirs."""
        for roles in permissions.values():
            for role in roles:
                check_role(role)
        given = self.spark.createDataFrame([(k, list(v)) for k, v in permissions.items()], ACL_SCHEMA)
        gone = self.read().join(given, "source_path", "left_anti").select(
            "source_path", F.lit(None).cast("array<string>").alias("allowed_roles")
        )
        self.append(given.unionByName(gone))

    def grant(self, names: Sequence[str] | DataFrame, roles: Sequence[str]) -> None:
        """Set the roles of some files (names, or rows with source_path), leaving those of others."""
        held = sorted({check_role(r) for r in roles})
        if not isinstance(names, DataFrame):
            names = self.spark.createDataFrame([(n,) for n in names], "source_path string")
        given = F.array(*[F.lit(r) for r in held]).cast("array<string>")
        self.append(names.select("source_path").distinct().withColumn("allowed_roles", given))


def upload_contracts(
    documents: DataFrame, existing: DataFrame, actor_role: str, allowed_roles: Sequence[str]
) -> DataFrame:
    """Accepted rows of a contract batch with their roles.

    The actor must be admin or legal; names already present are refused, and so
    are files that did not parse. The caller appends the result in one write,
    so a refused batch leaves nothing behind.
    """
    if check_role(actor_role) not in V.UPLOAD_ROLES:
        raise PermissionError("only admin or legal may upload contracts")
    roles = sorted({check_role(r) for r in allowed_roles})
    if not roles:
        raise ValueError("at least one role is needed")
    if documents.join(existing, "source_path", "left_semi").take(1):
        raise ValueError("a contract of that name exists; rename the file")
    failed = documents.where(F.col("status") != "ready").select("source_path", "error").take(1)
    if failed:
        raise ValueError(f"contract could not be read: {failed[0]['source_path']}: {failed[0]['error']}")
    return documents.withColumn("knowledge_base_id", F.lit("contracts")).withColumn(
        "allowed_roles", F.array(*[F.lit(r) for r in roles])
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """One Markdown report per row, with its document id."""
    reports.select("document_id", "report").write.mode("overwrite").parquet(path)

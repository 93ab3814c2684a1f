"""Row generators: sections, overlapping windows, sentences, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.rules import vocabulary as V
from sourcelight.settings import DEFAULT_SETTINGS, Settings


def section_blocks(content: Column) -> Column:
    """Array of (section, body) of normalised text, split at level-2 headings.

    Text without such a heading is one body block. Text before the first
    heading, metadata sections, empty bodies and contents pages are dropped.
    """
    heading = r"(?m)^##\s+(?=\S)"
    pieces = F.split(content, heading, -1)
    blocks = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            X.strip(F.substring_index(p, "\n", 1)).alias("section"),
            X.strip(F.when(p.contains("\n"), F.regexp_replace(p, r"\A[^\n]*\n", "")).otherwise("")).alias("body"),
        ),
    )
    kept = F.filter(
        blocks,
        lambda b: (b["body"] != "") & ~b["section"].isin(*V.METADATA_SECTIONS) & ~X.is_catalog(b["body"]),
    )
    whole = F.array(F.struct(F.lit(V.BODY_SECTION).alias("section"), content.alias("body")))
    return F.when(content == "", F.slice(whole, 1, 0)).when(content.contains("##") & content.rlike(heading), kept).otherwise(whole)


def window_count(length: Column, settings: Settings = DEFAULT_SETTINGS) -> Column:
    step = settings.chunk_size - settings.chunk_overlap
    extra = F.ceil((length - settings.chunk_size) / F.lit(float(step))).cast("int")
    return F.greatest(extra, F.lit(0)) + 1


def windows(body: Column, settings: Settings = DEFAULT_SETTINGS) -> Column:
    """Overlapping character windows; the last one reaches the end of the text."""
    step = settings.chunk_size - settings.chunk_overlap
    return F.transform(
        F.sequence(F.lit(0), window_count(F.length(body), settings) - 1),
        lambda i: F.substring(body, i * step + 1, F.lit(settings.chunk_size)),
    )


def split_documents(docs: DataFrame, settings: Settings = DEFAULT_SETTINGS) -> DataFrame:
    """Chunks of all ready documents. Narrow: no shuffle, columns pass through.

    ``chunk_index`` runs across the sections of a document; its offset per
    section is a prefix sum inside the row, so no window over rows is needed.
    """
    carried = [
        c
        for c in ("document_id", "title", "category", "source_path", "knowledge_base_id", "allowed_roles", "doc_order")
        if c in docs.columns
    ]
    ready = docs.where(F.col("status") == "ready")
    counted = ready.select(*carried, section_blocks(F.col("content")).alias("_blocks")).select(
        *carried,
        "_blocks",
        F.transform("_blocks", lambda b: window_count(F.length(b["body"]), settings)).alias("_counts"),
    )
    sections = counted.select(
        *carried,
        F.posexplode(
            F.transform(
                "_blocks",
                lambda b, i: F.struct(
                    b["section"].alias("section"),
                    b["body"].alias("body"),
                    F.aggregate(F.slice("_counts", F.lit(1), i), F.lit(0), lambda a, n: a + n).alias("start"),
                ),
            )
        ).alias("_no", "_b"),
    )
    return (
        sections.select(
            *carried,
            F.col("_b.section").alias("section"),
            F.col("_b.start").alias("_start"),
            F.posexplode(windows(F.col("_b.body"), settings)).alias("_w", "content"),
        )
        .withColumn("chunk_index", F.col("_start") + F.col("_w"))
        .withColumn("chunk_id", F.format_string("%s-%03d", F.col("document_id"), F.col("chunk_index")))
        .select("chunk_id", *carried, "section", "content", "chunk_index")
    )


def explode_sentences(df: DataFrame, text: str = "content") -> DataFrame:
    return df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(X.sentences(F.col(text))).alias("position", "sentence"),
    )


def section_bodies(content: Column) -> Column:
    """Titles and bodies without white space of the sections of a text."""
    pieces = F.split(content, r"(?m)^#{1,6}\s+(?=[^\n]+\n)", -1)
    return F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("title"),
            X.compact(F.regexp_replace(p, r"\A[^\n]*\n", "")).alias("body"),
        ),
    )


def sections_holding(bodies: Column, evidence: Column) -> Column:
    """Titles of the ``section_bodies`` that hold a verified piece of the excerpt."""
    needles = F.filter(
        F.transform(
            F.split(evidence, "\n\n", -1), lambda n: F.regexp_replace(X.compact(n), "…+\\z", "")
        ),
        lambda n: F.length(n) >= 8,
    )
    starts = F.transform(needles, lambda n: F.substring(n, 1, 60))
    # An array of one element, so that the pieces are prepared once and not for every section.
    hits = F.get(
        F.transform(
            F.array(starts),
            lambda some: F.filter(bodies, lambda b: F.exists(some, lambda n: b["body"].contains(n))),
        ),
        F.lit(0),
    )
    return F.array_distinct(F.transform(hits, lambda b: b["title"]))


def evidence_sections(content: Column, evidence: Column) -> Column:
    """Titles of sections whose body holds a verified piece of the excerpt."""
    return sections_holding(section_bodies(content), evidence)

"""Registered queries of the pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.llm import (
    centroids, exact_dedup, html_text, merkle, mixing, packing, parity_join, phrase_index, pii, quality, simhash, spans,
    url_rules,
)
from sourcelight.llm.common import saved, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def tokenizer_files() -> tuple[str, str, str]:
    """Encoder arguments of the byte-level vocabulary that the contract names."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


#: host, path, verdict: the contract's rules
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query
def op1_mixing(spark, sf_dir):
    placed = mixing.mix_sources(table(spark, sf_dir, "documents"), max_repetition=1.25)
    return placed.select("doc_id", "source", "n_tokens", "epoch", "block", "place")


@query
def op2_main_text(spark, sf_dir):
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query
def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_exact_dedup(spark, sf_dir):
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query
def op8_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


@query
def op9_packing(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_files())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op5_simhash(spark, sf_dir):
    """Every 50th document also asks how many others lie within 17 bits (README: what that finds)."""
    prints = saved(simhash.edited_fingerprints(table(spark, sf_dir, "documents")), "simhash-prints")
    near = simhash.near_counts(prints.select("doc_id", "f1", "f2"), F.col("doc_id") % 50 == 0, radius=17, flips=2)
    return prints.join(near.withColumnRenamed("doc_id", "_asked").hint("merge"), F.col("doc_id") == F.col("_asked"), "left").select(
        "doc_id", "n_chars", "edited_sha256",
        simhash.told(F.col("f1"), F.col("f2")).alias("fingerprint"),
        simhash.told(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        "near_edited", "near_next", "n_near",
    )


@query
def op10_span_dedup(spark, sf_dir):
    return spans.drop_repeated_passages(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_parity_join(spark, sf_dir):
    like = parity_join.Likeness(words=4, num=85, den=100)
    return parity_join.similar_groups(table(spark, sf_dir, "documents"), like)


@query
def op11_centroids(spark, sf_dir):
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed="2:")
    return centroids.with_inertia(found).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"),
    )


@query
def op12_decontaminate(spark, sf_dir):
    found = phrase_index.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op13_merkle(spark, sf_dir):
    """Tampering adds 1 to n_chars where 7 divides the CRC of the id."""
    docs = table(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.digest(*[merkle.field(F.col(c)) for c in names])
    more = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    changed = merkle.digest(*[merkle.field(more.get(c, F.col(c))) for c in names])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    made = merkle.manifest(
        docs, F.col("lang"), F.col("doc_id"), leaf, {"doc_id": F.col("doc_id"), "tampered": F.when(hit, changed)}
    )
    return made.proofs.select(
        "doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

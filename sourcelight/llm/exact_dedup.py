"""Stateful streaming deduplication of whole texts.

A narrow arrivals table (stable id, digest, locator) is read as a stream. Keyed
state on disk (RocksDB, no watermark, so nothing expires) holds for each digest
the row that stays, its locator and the number of rows. On every digest that
was hit more than once the full bytes are compared; texts that only share a
digest are grouped again by the text itself.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.llm.common import new_folder, salt, salts, saved, whole_text

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each state partition reserves 4 MB of disk whatever it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ARRIVAL = "doc_id bigint, digest string, locator string"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def advance_state(
    spark: SparkSession, arrivals: str, state: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Feed all new files of the ``arrivals`` folder into the keyed state under ``state``; return the state's rows.

    Can be called again after more files arrived: the state continues. One row
    per digest: digest, keep (doc_id, locator), group_size.
    """
    source = spark.readStream.schema(ARRIVAL)
    if max_files_per_trigger:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)
    keyed = (
        source.parquet(arrivals)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    updates = f"{state}/updates"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with _conf(spark, STATE_CONF):
        stream = (
            keyed.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        stream.awaitTermination()
    # Both values only grow, so the largest of a digest's updates is its newest.
    return (
        spark.read.schema(keyed.schema)
        .option("recursiveFileLookup", "true")
        .parquet(updates)
        .groupBy("digest")
        .agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))
    )


def _clashing(texts: DataFrame, repeated: DataFrame, spread: int) -> DataFrame:
    """Digests of ``repeated`` under which not all texts have the same bytes.

    Smallest and largest text of a digest combine map-side, so a group of any
    size sends one pair of texts per task; the salt keeps the filtering join
    from gathering a group.
    """
    wanted = repeated.select(F.col("digest").alias("_digest"), salts(spread).alias("_salt")).hint("merge")
    held = texts.withColumn("_s", salt(spread, "doc_id"))
    held = held.join(
        wanted, (held["digest"] == wanted["_digest"]) & (held["_s"] == wanted["_salt"]), "left_semi"
    )
    pair = held.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return pair.where(F.col("low") != F.col("high")).select("digest")


def exact_groups(docs: DataFrame, digest=sha256, spread: int = 16) -> DataFrame:
    """Group equal texts; of each group the row with the largest doc_id stays.

    Returns one row per distinct (doc_id, text): doc_id, keep_id, group_size
    (rows, repeated ones counted), kept, digest, repeats (times this very row
    occurs). Null text counts as empty; a null doc_id counts as smallest. Equal
    rows are one document that occurs ``repeats`` times. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    arrivals = new_folder(spark, "dedup-arrivals")
    texts.select("doc_id", "digest", F.input_file_name().alias("locator")).write.parquet(arrivals)
    state = advance_state(spark, arrivals, new_folder(spark, "dedup-state"))
    repeated = saved(
        state.where("group_size > 1").select("digest", F.col("keep.doc_id").alias("keep_id"), "group_size"),
        "dedup-repeated",
    )
    clashing = saved(_clashing(texts, repeated, spread), "dedup-clashing")
    narrow = spark.read.schema(ARRIVAL).parquet(arrivals).select("doc_id", "digest")
    rows = narrow.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("repeats"))
    out = (
        rows.join(repeated, "digest", "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
        .select("doc_id", "keep_id", "group_size", "digest", "repeats")
    )
    if not clashing.isEmpty():
        odd = texts.join(clashing, "digest", "left_semi")
        exact = odd.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        each = odd.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("repeats"))
        again = each.join(exact, ["digest", "text"]).select(*out.columns)
        out = out.join(clashing, "digest", "left_anti").unionByName(again)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each exact text (the largest doc_id), columns unchanged.

    Rows go by doc_id and text, so other texts of the same doc_id stay.
    """
    groups = saved(exact_groups(docs).select("doc_id", "digest", "kept", "repeats"), "dedup-groups")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest"))
    digest = sha256(F.coalesce(docs["text"], F.lit("")))
    gone = gone.hint("merge")
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["_gone_id"]) & (digest == gone["_gone_digest"])
    rest = docs.join(gone, same, "left_anti")
    if groups.where("kept and repeats > 1").isEmpty():
        return rest
    return rest.dropDuplicates(["doc_id", "text"])

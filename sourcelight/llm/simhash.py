"""SimHash fingerprints, their likeness, and search within a Hamming radius.

Terms are pairs of neighbouring words, weighted by their letters, so pairs of
function words count least; each occurrence votes. A 128-bit hash of a term
adds its weight to the votes of the bits that it sets; a fingerprint bit is set
when more than half of the weight voted for it. Votes are summed two to a
64-bit counter (bits i and i + 32), which holds texts of up to 2 GB.

Only DataFrame functions: words are exploded beside a row key alone and the 64
counters combine map-side, one row per document and task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import whole_text

BITS = 128
_LANES = (1 << 32) | 1
_LOW = (1 << 32) - 1


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fingerprints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """128-bit fingerprints of ``texts``: ``key``, f1, f2 (64 bits each). Texts without words give no row.

    Equal texts have equal fingerprints. ``key`` must be a number and unique.
    """
    held = texts.select(key, words(F.col(text)).alias("_w"))
    w = F.col("_w")
    term = F.transform(
        w,
        lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1)).alias("h1"),
            (F.length(x) + F.coalesce(F.length(F.get(w, i + 1)), F.lit(0))).cast("bigint").alias("weight"),
        ),
    )
    each = held.select(key, F.inline(term)).withColumn("h2", F.xxhash64("h1", F.lit(1)))
    votes = [
        F.sum(F.col("weight") * F.shiftrightunsigned(f"h{half}", i).bitwiseAND(F.lit(_LANES))).alias(f"_v{half}_{i}")
        for half in (1, 2)
        for i in range(32)
    ]
    summed = each.groupBy(key).agg(F.sum("weight").alias("_all"), *votes)

    def half(n: int) -> Column:
        bits = F.lit(0).cast("bigint")
        for i in range(32):
            v = F.col(f"_v{n}_{i}")
            low, high = v.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(v, 32)
            for bit, count in ((i, low), (i + 32, high)):
                bits = bits.bitwiseOR(F.shiftleft((count * 2 > F.col("_all")).cast("bigint"), bit))
        return bits

    return summed.select(key, half(1).alias("f1"), half(2).alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def told(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def _block(start: int, end: int) -> Column:
    """Bits start to end (exclusive) of the fingerprint as a number; at most 64 bits."""
    taken = F.lit(0).cast("bigint")
    for n, low in ((1, 0), (2, 64)):
        a, b = max(start, low) - low, min(end, low + 64) - low
        if a < b:
            part = F.shiftrightunsigned(F.col(f"f{n}"), a)
            part = part if b - a == 64 else part.bitwiseAND(F.lit((1 << (b - a)) - 1))
            taken = taken.bitwiseOR(F.shiftleft(part, low + a - start))
    return taken


def block_tables(radius: int, kept: int, flips: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bit ranges of the blocks, and the block sets of all tables.

    Of radius // (flips + 1) + kept blocks, two fingerprints within the radius
    differ in more than ``flips`` bits on radius // (flips + 1) at most, so one
    table has none of those.
    """
    n = radius // (flips + 1) + kept
    ranges = [(BITS * i // n, BITS * (i + 1) // n) for i in range(n)]
    return ranges, list(combinations(range(n), kept))


def near_counts(prints: DataFrame, wanted: Column, radius: int = 3, kept: int = 1, flips: int = 0) -> DataFrame:
    """Rows of ``prints`` that meet ``wanted`` with the number of other rows within ``radius``: doc_id, n_near.

    ``prints``: doc_id, f1, f2; read more than once. Every pair within the
    radius differs in at most ``flips`` bits on each of ``kept`` blocks of bits,
    so it meets in one of the permuted tables, where the wanted side stands with
    all such changes of its blocks (of one block a table, if there are any); it
    is counted in the first one in which it meets. Equal fingerprints are one
    row with a count, on both sides, so a group of copies of any size meets once.
    """
    if flips and kept > 1:
        raise ValueError("changed bits are sought in tables of one block")
    ranges, tables = block_tables(radius, kept, flips)
    all_prints = prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("rows"))
    asked = prints.where(wanted).select("f1", "f2").distinct()

    held = F.array(*[F.xxhash64(F.lit(t), *[_block(*ranges[b]) for b in table]) for t, table in enumerate(tables)])
    b = all_prints.select("*", F.posexplode(held)).toDF("b1", "b2", "rows", "tb", "kb")
    if flips:
        masks = [
            (t, sum(1 << i for i in c)) for t, (start, end) in enumerate(ranges)
            for n in range(flips + 1) for c in combinations(range(end - start), n)
        ]
        # As many rows as the parameters give, whatever the corpus.
        changes = F.broadcast(prints.sparkSession.createDataFrame(masks, "_t int, mask bigint"))
        blocks = F.array(*[F.struct(F.lit(t).alias("t"), _block(*r).alias("block")) for t, r in enumerate(ranges)])
        probed = asked.select("f1", "f2", F.inline(blocks)).join(changes, F.col("t") == F.col("_t"))
        a = probed.select("f1", "f2", F.xxhash64("t", F.col("block").bitwiseXOR(F.col("mask"))))
    else:
        a = asked.select("f1", "f2", F.explode(held))
    a = a.toDF("a1", "a2", "ka")

    def differ(start: int, end: int) -> Column:
        bits = F.lit(0)
        for n, low in ((1, 0), (2, 64)):
            x, y = max(start, low) - low, min(end, low + 64) - low
            if x < y:
                mask = ((1 << (y - x)) - 1) << x
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                bits = bits + F.bit_count(F.col(f"a{n}").bitwiseXOR(F.col(f"b{n}")).bitwiseAND(F.lit(mask)))
        return bits

    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        met = F.lit(True)
        for block in tables[t]:
            met = met & (differ(*ranges[block]) <= flips)
        first = F.when(met, t).otherwise(first)
    close = distance(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")) <= radius
    # Both sides grow with the corpus, so neither is ever sent to all tasks.
    met = a.hint("merge").join(b.hint("merge"), (F.col("ka") == F.col("kb")) & close & (first == F.col("tb")))
    counts = met.groupBy("a1", "a2").agg((F.sum("rows") - 1).alias("n_near"))
    ids = prints.where(wanted).select("doc_id", "f1", "f2")
    return ids.join(counts.hint("merge"), (F.col("f1") == F.col("a1")) & (F.col("f2") == F.col("a2"))).select("doc_id", "n_near")


def _with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next one, by descending doc_id; after the last comes the first.

    Rows are dealt to ranges of doc_id (approximate quantiles, which place rows
    and never change the result) and ordered within each. A copy of the first
    row of the range below closes each range, so no row is sought elsewhere.
    Columns: bucket, rank, guest (such a copy), doc_id, text, next_text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 10000)).first()[0] or []
    bounds = sorted(set(bounds))
    at_or_above = F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= F.col("doc_id"))
    # Rows without an id come last, by the hash of their text; the buckets below zero are ranges of it.
    high = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))), 33)
    no_id = (-1 - F.shiftright(high * parts, 31)).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), no_id).otherwise(F.size(at_or_above) if bounds else F.lit(0))
    dealt = rows.withColumn("bucket", bucket)
    tops = sorted(
        ((r["bucket"], r["top"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()),
        reverse=True,
    )
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    #: bucket -> the bucket that follows it
    follows = spark.createDataFrame(
        [(tops[(i + 1) % len(tops)][0], b) for i, (b, _) in enumerate(tops)], "source int, target int"
    )
    ids = [t for _, t in tops if t is not None]
    heads = dealt.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull() if ids else F.col("doc_id").isNull())
    ranked = heads.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where("n = 1")
    guests = ranked.join(F.broadcast(follows), F.col("bucket") == F.col("source")).select(
        "doc_id", "text", F.col("target").alias("bucket"), F.lit(True).alias("guest")
    )
    line = Window.partitionBy("bucket").orderBy(F.col("guest"), *order)
    return (
        dealt.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .withColumn("next_text", F.lead("text").over(line))
        .withColumn("rank", F.row_number().over(line))
    )


def edited(text: Column, next_text: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms.

    Returns doc_id, n_chars, edited_sha256, f1, f2, e1, e2, near_edited,
    near_next. Null texts count as empty and have the fingerprint zero; a null
    doc_id comes last in the order; equal rows are documents of their own,
    ordered by text. One document is its own next. An empty table gives no rows.
    """
    if docs.select("doc_id").isEmpty():
        shape = "doc_id bigint, n_chars bigint, edited_sha256 string, f1 bigint, f2 bigint, e1 bigint, e2 bigint"
        return docs.sparkSession.createDataFrame([], shape + ", near_edited double, near_next double")
    lined = _with_next(docs)
    key = F.shiftleft((F.col("bucket") + 1).cast("bigint"), 40).bitwiseOR(F.col("rank").cast("bigint"))
    lined = lined.withColumn("row", key)
    change = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    facts = lined.select(
        "row", "bucket", "rank", "guest", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(change.cast("binary"), 256).alias("edited_sha256"),
    )
    both = lined.select(
        F.explode(
            F.array(
                F.struct((F.col("row") * 2).alias("k"), F.col("text").alias("t")),
                F.struct(F.when(~F.col("guest"), F.col("row") * 2 + 1).alias("k"), change.alias("t")),
            )
        ).alias("x")
    ).select("x.*").where("k is not null")
    prints = fingerprints(both, "k", "t")
    paired = prints.groupBy(F.shiftright("k", 1).alias("_row")).agg(
        *[
            F.max(F.when(F.col("k").bitwiseAND(F.lit(1)) == side, F.col(c))).alias(name + c[1])
            for side, name in ((0, "f"), (1, "e"))
            for c in ("f1", "f2")
        ]
    )
    zero = F.lit(0).cast("bigint")
    joined = facts.join(paired, F.col("row") == F.col("_row"), "left").select(
        *facts.columns, *[F.coalesce(c, zero).alias(c) for c in ("f1", "f2", "e1", "e2")]
    )
    line = Window.partitionBy("bucket").orderBy("rank")
    ahead = joined.withColumn("_n1", F.lead("f1").over(line)).withColumn("_n2", F.lead("f2").over(line))
    f1, f2 = F.col("f1"), F.col("f2")
    return ahead.where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", "f1", "f2", "e1", "e2",
        (1 - distance(f1, f2, F.col("e1"), F.col("e2")) / BITS).alias("near_edited"),
        (1 - distance(f1, f2, F.col("_n1"), F.col("_n2")) / BITS).alias("near_next"),
    )

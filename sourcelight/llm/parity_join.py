"""Jaccard join of word n-gram sets by parity sketches.

Every shingle hash flips one bit of a document's sketch, so the Hamming
distance of two sketches never exceeds the symmetric difference of the sets;
nor does the number of sketch blocks in which they differ. Sets that reach the
similarity differ in at most D shingles, D given by their sizes. Within a band
of sizes, sketches are cut into D + 1 + 2s blocks: two similar sets agree on
2s + 1 blocks at least, so each may leave out any s (more, if it is small in its
band) and still one common block is joined on. A document leaves out those that most documents share (empty ones,
and what common passages fill), so they bring no pairs. Blocks are wide, and kept as the XOR of their bits'
random numbers. Sketches of two to four bits a shingle then screen the pairs,
and the sets themselves decide.

The result is the components of all links. A bucket of equal blocks first links
its members to its least one; pairs of other members are compared only where a
bucket still spans several components, so a group of copies of any size costs
about one comparison per member, and no link that joins components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import salt, saved, whole_text, without
from sourcelight.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAND = 1.5  #: ratio of the sizes in a band
SLACK = 0.1  #: share of blocks a document may leave out
MARK, MORE = 16, 64  #: 64-bit words of the screening sketches that travel with the keys
HOT_KEYS, HOT_SALTS = 1024, 32
ORDERS = 32  #: orders in which buckets pick their center, so that members of a large group meet several of it
STEP = 1000  #: sets that a task sketches at a time
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Likeness:
    """Documents are linked when ``den`` * intersection >= ``num`` * union of their ``words``-word shingles."""

    words: int = 5
    num: int = 80
    den: int = 100

    def most_apart(self, sizes: int) -> int:
        """Largest symmetric difference of two similar sets whose sizes sum to ``sizes``."""
        return (self.den - self.num) * sizes // (self.den + self.num)


def words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased; ``shingle_set`` reads them as column ``_w``."""
    parts = F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingle_set(n: int) -> Column:
    """Distinct hashes of n neighbouring words of ``_w``; of the whole sequence if it is shorter; empty without words."""
    w = F.col("_w")
    each = F.transform(
        F.slice(w, 1, F.size(w) - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)])
    )
    return (
        F.when(F.size(w) >= n, F.array_distinct(each))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(largest: int) -> list[int]:
    """Least size of each band."""
    starts = [1, 2]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return starts


def block_plan(start_of_next: int, n: int, like: Likeness) -> tuple[int, int]:
    """Blocks of the band that ends before ``start_of_next``, and how many of them a set of ``n`` shingles may leave out.

    Similar sets of n and m shingles agree on at least blocks - d (n + m) of
    them, d = (den - num) / (den + num). Each leaves out (blocks - 1) / 2 - d
    times its own size, so one common block is left whatever both leave out.
    """
    apart = like.most_apart(2 * (start_of_next - 1))
    blocks = apart + 1 + (0 if apart == 0 else 2 * max(1, round(SLACK * (apart + 1))))
    near, far = like.den + like.num, like.den - like.num
    return blocks, max(0, ((blocks - 1) * near - 2 * far * n) // (2 * near))


def block_keys(hashes: np.ndarray, like: Likeness) -> tuple[np.ndarray, list[int]]:
    """Join keys of one set, and how many a document may leave out of those with an even and an odd last bit.

    Keys are the blocks of its own size band, and of the next if a similar
    larger set may lie there; the last bit tells the bands apart.
    """
    n, keys, spares = len(hashes), [np.zeros(0, dtype=np.uint64)], [0, 0]
    starts = bands(n)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    where, token = mixed(hashes), mixed(hashes + np.uint64(0x9E3779B97F4A7C15))
    for band in (own, own + 1) if n else ():
        if band > own and like.den * n < like.num * starts[band]:
            break
        end = starts[band + 1] if band + 1 < len(starts) else max(starts[band] + 1, int(starts[band] * BAND))
        blocks, spares[band % 2] = block_plan(end, n, like)
        at = (where % np.uint64(blocks)).astype(np.int64)
        parity = np.zeros(blocks, dtype=np.uint64)
        np.bitwise_xor.at(parity, at, token)
        place = np.arange(blocks, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(band + 1)
        keys.append(mixed(parity ^ mixed(place)) & ~np.uint64(1) | np.uint64(band % 2))
    return np.concatenate(keys).view(np.int64), spares


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch of 64 * 2**k bits, at least two bits a shingle and MARK words.

    The XOR of both halves is the sketch of half the length, so sketches of two
    lengths compare after folding.
    """
    words = MARK
    while 64 * words < 2 * len(hashes):
        words *= 2
    at = (mixed(hashes) & np.uint64(64 * words - 1)).astype(np.int64)
    bits = np.bincount(at, minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sketch: np.ndarray, words: int = MARK) -> np.ndarray:
    """The sketch of so many words, a power of two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def more_of(sketch: np.ndarray) -> np.ndarray | None:
    """For large sets a sketch of 32 or 64 words, one bit or more a shingle; 16 words tell smaller ones apart."""
    words = min(MORE, len(sketch) // 2)
    return folded(sketch, words) if words > MARK else None


def _sketched(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            sets = batch.column(1)
            values = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.cumsum(np.concatenate([[0], sets.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64)
            parts = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            wide = [parity_sketch(p) for p in parts]
            found = [block_keys(p, like) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([keys for keys, _ in found], pa.list_(pa.int64())),
                    pa.array([spares for _, spares in found], pa.list_(pa.int64())),
                    pa.array([folded(w) for w in wide], pa.list_(pa.int64())),
                    pa.array([more_of(w) for w in wide], pa.list_(pa.int64())),
                    pa.array(wide, pa.list_(pa.int64())),
                ],
                names=["doc", "n", "keys", "spares", "mark", "more", "wide"],
            )

    return run


def _hot_keys(sketches: DataFrame) -> DataFrame:
    """At most HOT_KEYS keys that many documents of a sample hold. The list only says which keys to salt."""
    some = sketches.where(F.pmod(F.xxhash64("doc"), F.lit(64)) == 0).select(F.explode("keys").alias("key"))
    often = some.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c >= 50").orderBy(F.desc("c"), "key")
    return often.limit(HOT_KEYS).select(F.col("key").alias("_hot"))


def _kept_keys(sketches: DataFrame) -> DataFrame:
    """(key, doc, hot): keys that other documents share, without each document's most shared ones, as many as it may leave out.

    Which ones are left out never changes the result, so the counts of hot keys
    may be those of their salted part; their rows stay in any case.
    """
    hot = F.broadcast(saved(_hot_keys(sketches), "parity-hot"))
    rows = sketches.select("doc", F.explode("keys").alias("key")).join(hot, F.col("key") == F.col("_hot"), "left")
    rows = rows.select(
        "doc", "key", F.when(F.col("_hot").isNotNull(), salt(HOT_SALTS, "doc") + 1).otherwise(0).alias("part")
    )
    held = F.count(F.lit(1)).over(Window.partitionBy("key", "part"))
    shared = rows.withColumn("c", F.when(F.col("part") > 0, held * HOT_SALTS).otherwise(held)).where("c > 1")
    shared = saved(shared.select("key", "doc", "c", (F.col("part") > 0).alias("hot")), "parity-shared")
    spares = sketches.select("doc", "spares").hint("merge")
    bit = F.col("key").bitwiseAND(F.lit(1))
    most = Window.partitionBy("doc", bit).orderBy(F.desc("c"), "key")
    ranked = shared.join(spares, "doc").withColumn("_rank", F.row_number().over(most))
    return ranked.where(F.col("_rank") > F.get("spares", bit.cast("int"))).select("key", "doc", "hot")


def _stars(kept: DataFrame) -> DataFrame:
    """(key, center, doc) for every document but the center of each bucket; hot buckets in two levels.

    The center is the first document in one of many hash orders, which the key
    chooses.
    """
    first = F.xxhash64("doc", F.pmod(F.shiftright("key", 1), F.lit(ORDERS)))
    rows = kept.withColumn("s", F.when(F.col("hot"), salt(HOT_SALTS, "doc")).otherwise(0)).withColumn("h", first)
    past = (Window.unboundedPreceding, Window.currentRow)
    line = Window.partitionBy("key", "s").orderBy("h", "doc").rowsBetween(*past)
    near = rows.withColumn("center", F.first("doc").over(line))
    level = near.where("doc != center").select("key", "center", "doc")
    tops = rows.where("hot").groupBy("key", "s").agg(F.min(F.struct("h", "doc")).alias("t")).select("key", "t.*")
    top = Window.partitionBy("key").orderBy("h", "doc").rowsBetween(*past)
    tops = tops.withColumn("center", F.first("doc").over(top)).where("doc != center").select("key", "center", "doc")
    return level.unionByName(tops)


def _bound(like: Likeness) -> Column:
    """Largest symmetric difference that sets of sizes ``na`` and ``nb`` may have; negative if the sizes alone forbid a link."""
    n, m = F.least("na", "nb"), F.greatest("na", "nb")
    bound = F.floor((like.den - like.num) * (n + m) / (like.den + like.num))
    return F.when(like.den * n >= like.num * m, bound).otherwise(-1)


def _apart(a: Column, b: Column) -> Column:
    """Hamming distance of two sketches of MARK words."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, MARK)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _halved(sketch: Column, to: Column) -> Column:
    """The sketch folded once if it is longer than ``to`` words; similar sets differ by one doubling at most."""
    half = (F.size(sketch) / 2).cast("int")
    fold = F.transform(F.slice(sketch, 1, half), lambda x, i: x.bitwiseXOR(F.get(sketch, i + half)))
    return F.when(F.size(sketch) > to, fold).otherwise(sketch)


def _apart_of_any(a: Column, b: Column) -> Column:
    """Hamming distance of two sketches whose lengths are equal or differ by one doubling."""
    bits = F.zip_with(_halved(a, F.size(b)), _halved(b, F.size(a)), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, c: acc + c)


def _screened(pairs: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity; the short sketches first."""
    facts, wide = sketches.select("doc", "n", "mark"), sketches.select("doc", "n", "wide")
    some = pairs.join(facts.toDF("a", "na", "ma"), "a").join(facts.toDF("b", "nb", "mb"), "b")
    some = some.where((_bound(like) >= 0) & (_apart(F.col("ma"), F.col("mb")) <= _bound(like))).select("a", "b")
    both = some.join(wide.toDF("a", "na", "wa"), "a").join(wide.toDF("b", "nb", "wb"), "b")
    return both.where(_apart_of_any(F.col("wa"), F.col("wb")) <= _bound(like)).select("a", "b")


def _sets_of(texts: DataFrame, ids: DataFrame, like: Likeness) -> DataFrame:
    """Shingle sets of the documents in ``ids`` (doc): a merge join at every size, as both sides grow with the corpus."""
    held = texts.join(ids.hint("merge"), "doc", "left_semi")
    return held.select("doc", words(F.col("text")).alias("_w")).select(
        "doc", shingle_set(like.words).alias("grams")
    )


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets."""
    kept = saved(_screened(pairs, sketches, like), "parity-pairs")
    ends = kept.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = saved(_sets_of(texts, ends, like), "parity-sets")
    a, b = sets.toDF("a", "ga").hint("merge"), sets.toDF("b", "gb").hint("merge")
    shared = F.size(F.array_intersect("ga", "gb"))
    both = kept.join(a, "a").join(b, "b").select("a", "b", shared.alias("i"), (F.size("ga") + F.size("gb")).alias("s"))
    return both.where(like.den * F.col("i") >= like.num * (F.col("s") - F.col("i"))).select("a", "b")


def _across(stars: DataFrame, labels: DataFrame, sketches: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of different components that share a bucket and may be similar: all links the stars can have missed."""
    of_doc = labels.toDF("doc", "_cd")
    of_center = labels.toDF("center", "_cc")
    told = stars.join(of_doc, "doc", "left").join(of_center, "center", "left").select(
        "key", "doc", "center", F.coalesce("_cd", "doc").alias("cd"), F.coalesce("_cc", "center").alias("cc")
    )
    told = saved(told, "parity-told")
    open_keys = told.where("cd != cc").select("key").distinct()
    rows = told.join(open_keys, "key", "left_semi")
    members = (
        rows.select("key", F.col("doc").alias("doc"), F.col("cd").alias("c"))
        .unionByName(rows.select("key", F.col("center").alias("doc"), F.col("cc").alias("c")))
        .distinct()
    )
    full = saved(members.join(sketches.select("doc", "n", "mark", "more"), "doc"), "parity-open")
    side = lambda x: full.select(
        F.col("key").alias(f"k{x}"), F.col("doc").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in ("n", "mark", "c")],
        F.col("more").alias(f"w{x}"),
    )
    bound = _bound(like)
    large = F.col("wa").isNotNull() & F.col("wb").isNotNull()
    met = side("a").join(
        side("b"),
        (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
        & (_apart(F.col("ma"), F.col("mb")) <= bound)
        & F.when(large, _apart_of_any(F.col("wa"), F.col("wb")) <= bound).otherwise(True),
    )
    return met.select("a", "b").distinct()


def similar_groups(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Component of every document in the graph of links: doc_id, n_shingles, component_id (least doc_id reachable).

    Null text counts as empty; a text without words has an empty set and no
    link. Rows equal in doc_id are one document (of several texts under one
    doc_id, the one with the least SHA-256). A null doc_id counts as the least
    and is returned as null. An empty table gives no rows. Other columns are
    ignored. Copies are reduced to their least doc_id before anything is joined.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), whole_text().alias("text"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    held = saved(texts.groupBy("doc").agg(F.min(digest).alias("digest")), "parity-digests")
    firsts = held.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    firsts = saved(firsts.select("digest", "first"), "parity-firsts").hint("merge")
    members = saved(
        held.join(firsts, "digest", "left").select("doc", "digest", F.coalesce("first", "doc").alias("first")),
        "parity-members",
    )
    copies = members.where("doc != first").select("doc")
    several = saved(
        texts.select("doc", digest.alias("digest")).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1"),
        "parity-several",
    )
    if not several.isEmpty():
        kept = members.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"))
        texts = texts.join(kept, (F.col("doc") == F.col("_doc")) & (digest == F.col("_digest")), "left_semi")
    single = texts.join(copies.hint("merge"), "doc", "left_anti")
    grams = single.select("doc", words(F.col("text")).alias("_w")).select(
        "doc", shingle_set(like.words).alias("grams")
    )
    shape = "doc bigint, n bigint, " + ", ".join(f"{c} array<bigint>" for c in ("keys", "spares", "mark", "more", "wide"))
    sketches = saved(grams.mapInArrow(_sketched(like), shape), "parity-sketches")
    stars = saved(_stars(saved(_kept_keys(sketches), "parity-kept")), "parity-stars")
    links = saved(
        _verified(
            stars.select(F.least("center", "doc").alias("a"), F.greatest("center", "doc").alias("b")).distinct(),
            sketches, texts, like,
        ),
        "parity-links",
    )
    labels = saved(components(links.toDF("u", "v")), "parity-labels")
    more = saved(_across(stars, labels, sketches, like), "parity-across")
    if not more.isEmpty():
        links = links.unionByName(saved(_verified(more, sketches, texts, like), "parity-more"))
        labels = saved(components(links.toDF("u", "v")), "parity-labels")
    sizes = sketches.select(F.col("doc").alias("first"), "n").distinct()
    named = labels.select(F.col("node").alias("first"), "component")
    out = members.join(sizes, "first").join(named, "first", "left")
    return out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("component", "first")).alias("component_id"),
    ).withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")))


def keep_one_of_each_group(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the least doc_id; columns unchanged."""
    groups = saved(similar_groups(docs, like), "parity-groups")
    return without(docs, groups.where("component_id is null and doc_id is not null or component_id < doc_id").select("doc_id"))

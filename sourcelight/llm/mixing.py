"""Temperature mixing of sources.

Source token shares p are raised to an exponent a (0: all sources alike, 1: as
they are) and normalised. The exponent is found by repeated section of [0, 1]:
either the flattest mixture in which no source is repeated more often than a
limit, or the one whose entropy meets a target. The weights are then realised
as a sequence of blocks of a token budget; every block holds each source in its
share, drawn from hash permutations of the source's documents.

Only DataFrame functions. A source may hold any share of the rows: the running
token sums of a source are taken within hash slices, and only slice totals are
summed across a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import saved, whole_text

SLICES = 4096
SECTIONS = 64


def token_count(text: Column) -> Column:
    """Words of a text; at least one, so that every document takes room."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, text): doc_id, source, text_hash, n_tokens. Null source is a source of its own."""
    return docs.select(
        "doc_id", "source", F.sha2(whole_text().cast("binary"), 256).alias("text_hash"),
        token_count(whole_text()).alias("n_tokens"),
    ).distinct()


def source_shares(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    return sums


def _sections(low: float, high: float) -> list[float]:
    return [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]


def _measure(shares: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy in nats, repetitions of the most repeated source against the least), one aggregate over sources."""
    p = F.col("tokens") / F.lit(float(total))
    each = shares.select(p.alias("p"), F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    power = F.pow("p", F.col("a"))
    sums = each.groupBy("a").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.log("p")).alias("l"),
        (F.max(F.pow("p", F.col("a") - 1)) / F.min(F.pow("p", F.col("a") - 1))).alias("r"),
    )
    rows = sums.select("a", (F.log("z") - F.col("a") * F.col("l") / F.col("z")).alias("h"), "r").collect()
    return sorted((r["a"], r["h"], r["r"]) for r in rows)


def find_exponent(
    shares: DataFrame, max_repetition: float | None = None, target_entropy: float | None = None, rounds: int = 4
) -> float:
    """Exponent in [0, 1], rounded to six digits.

    ``max_repetition``: the smallest exponent at which no source is repeated
    more than this often when the least repeated one is used once.
    ``target_entropy``: a fraction of the entropy of equal shares; the largest
    exponent that reaches it. One of both must be given. The entropy falls and
    the repetition ratio falls as the exponent grows, so each round keeps one of
    64 sections: four rounds halve the interval 24 times.
    """
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either max_repetition or target_entropy")
    head = shares.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not head["n"]:
        return 1.0
    goal = None if target_entropy is None else target_entropy * math.log(head["n"])

    def flat_enough(entropy: float, ratio: float) -> bool:
        return ratio <= max_repetition + 1e-12 if goal is None else entropy < goal

    low, high = 0.0, 1.0
    for _ in range(rounds):
        seen = _measure(shares, head["t"], _sections(low, high))
        met = next((i for i, (_, h, r) in enumerate(seen) if flat_enough(h, r)), len(seen) - 1)
        low, high = seen[max(met - 1, 0)][0], seen[met][0]
    return round(high if goal is None else low, 6)


def mixture(
    rows: DataFrame, max_repetition: float | None = 1.25, target_entropy: float | None = None, budget: int | None = None
) -> tuple[DataFrame, float]:
    """Weights of all sources: source, tokens, docs, weight, quota (tokens to draw), epochs (quota / tokens); and the exponent.

    Without a ``budget`` it is the smallest one that draws every source at least
    once, so no document is left out.
    """
    shares = saved(source_shares(rows), "mixing-shares")
    exponent = find_exponent(shares, max_repetition, target_entropy)
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))
    z = shares.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("most")).first()
    size = float(budget) if budget is not None else (z["most"] or 0.0) * (z["z"] or 0.0)
    weights = shares.select(
        "source", "tokens", "docs", F.round(power / F.lit(z["z"] or 1.0), 9).alias("weight"),
        F.round(power / F.lit(z["z"] or 1.0) * F.lit(size)).cast("bigint").alias("quota"),
    )
    return weights.withColumn("epochs", F.round(F.col("quota") / F.col("tokens"), 6)), exponent


def schedule(rows: DataFrame, weights: DataFrame, block_tokens: int = 1 << 18, seed: int = 7) -> DataFrame:
    """Place documents on the sequence of blocks.

    ``rows`` as from ``measured``. A source with e epochs gives every document
    in floor(e) whole passes and the documents first in a hash order in the
    pass that is left, up to its tokens. The running tokens of a source, over
    its quota, are a time between 0 and 1; times are cut into blocks of about
    ``block_tokens`` and a block is a hash permutation of its documents.

    Returns doc_id, source, text_hash, n_tokens, epoch (from 0), block (from 0),
    place (rank inside the block, from 0).
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash"))
    w = weights.select(F.col("source").alias("_source"), F.col("tokens").alias("_all"), "quota", "epochs")
    keyed = rows.withColumn("_order", order).withColumn(
        "_slice", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int") % SLICES
    )
    totals = keyed.groupBy("source", "_slice").agg(F.sum("n_tokens").alias("_in_slice"))
    line = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_in_slice").over(line), F.lit(0))).drop("_in_slice")
    starts = (
        totals.join(w, totals["source"].eqNullSafe(w["_source"]))
        .select(F.col("source").alias("_source"), F.col("_slice").alias("_in"), "_before", "_all", "quota", "epochs")
    )
    inner = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id")
    running = keyed.withColumn(
        "_inner", F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    at = running.join(
        starts, running["source"].eqNullSafe(starts["_source"]) & (running["_slice"] == starts["_in"])
    ).withColumn("_start", F.col("_before") + F.col("_inner") - F.col("n_tokens"))
    # Passes in which the document's first token still lies within the quota.
    passes = F.ceil((F.col("quota") - F.col("_start")) / F.col("_all")).cast("int")
    drawn = at.where(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    size = weights.agg(F.sum("quota").alias("t")).first()["t"] or 0.0
    blocks = max(1, math.ceil(size / block_tokens))
    time = (F.col("_start") + F.col("epoch") * F.col("_all")) / F.col("quota")
    placed = drawn.withColumn("block", F.least(F.floor(time * blocks), F.lit(blocks - 1)).cast("bigint"))
    shuffled = F.md5(F.concat_ws("|", "_order", F.col("epoch").cast("string")))
    rank = Window.partitionBy("block").orderBy("_shuffled", "doc_id")
    return (
        placed.withColumn("_shuffled", shuffled)
        .withColumn("place", F.row_number().over(rank).cast("bigint") - 1)
        .select("doc_id", "source", "text_hash", "n_tokens", F.col("epoch").cast("bigint").alias("epoch"), "block", "place")
    )


def mix_sources(docs: DataFrame, block_tokens: int = 1 << 18, **limits) -> DataFrame:
    """Schedule of the whole table: see ``schedule``; ``limits`` as of ``mixture``.

    Null and empty texts count one token, a null source is a source, rows equal
    in doc_id, source and text are one document, an empty table gives no rows.
    Only doc_id, source and text are read.
    """
    rows = saved(measured(docs), "mixing-rows")
    weights, _ = mixture(rows, **limits)
    return schedule(rows, saved(weights, "mixing-weights"), block_tokens)


def mixed_documents(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` itself in its mixture: a row drawn in n passes comes n times; columns unchanged.

    Every document comes at least once unless a budget is given.
    """
    drawn = mix_sources(docs, **limits).groupBy("doc_id", "source", "text_hash").agg(
        F.count(F.lit(1)).cast("int").alias("_times")
    )
    drawn = drawn.toDF("_drawn_id", "_drawn_source", "_drawn_hash", "_drawn_times").hint("merge")
    hashed = docs.withColumn("_drawn_text", F.sha2(whole_text().cast("binary"), 256))
    both = hashed.join(
        drawn,
        hashed["doc_id"].eqNullSafe(drawn["_drawn_id"])
        & hashed["source"].eqNullSafe(drawn["_drawn_source"])
        & (hashed["_drawn_text"] == drawn["_drawn_hash"]),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("_drawn_times"))).alias("_drawn_copy")
    return both.select(*[docs[c] for c in docs.columns], copies).drop("_drawn_copy")

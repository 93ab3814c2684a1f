"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelight.llm.common import saved


def _toward_least(pairs: DataFrame, include_self: bool) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` to the least of them and ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u")
    out = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if include_self:
        out = out.unionByName(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges`` (u, v) with the least node of its component: node, component.

    Alternates two star contractions: larger neighbours are linked to a node's
    least neighbour, then smaller ones to the least of them, until every
    component is a star. Rounds grow with the logarithm of the nodes. Minima
    combine map-side; the join that follows keeps the edges of a node together,
    a pair of numbers each. Each round is written to the shared folder.
    """
    now = saved(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node's larger neighbours go to its least one
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = saved(_toward_least(saved(large, "edges"), True).distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

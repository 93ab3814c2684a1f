"""Centroid clustering of integer vectors, nearest centroids found in a vantage-point tree.

Every round rebuilds a vantage-point tree over the centroids on the driver and
broadcasts it (k vectors, whatever the table's size). Each vector descends it
best-first: it opens the pending node with the least lower bound, takes the
exact integer distance to that node's centroid, and stops when no bound is
within its best distance. Vectors of a batch do so in step, so each step is one
array operation. Tasks add up their vectors per centroid; only k sums a task
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelight.llm.common import saved

#: Components beyond this are set to it, so squared distances of 64 components fit in 64 bits.
LIMIT = 1 << 27
_ROWS = 4096


class VantageTree:
    """Balanced tree with one centroid a node; equal distances may lie on either side."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        n = len(centroids)
        self.centroid = np.zeros(n, np.int64)  # of each node
        self.child = np.full((n, 2), -1, np.int64)
        self.low = np.zeros((n, 2))  # least and greatest distance from the node's centroid to those below a child
        self.high = np.zeros((n, 2))
        self._next = 0
        if n:
            self._grow(np.arange(n))

    def _grow(self, members: np.ndarray) -> int:
        node, self._next = self._next, self._next + 1
        spread = self.centroids[members].astype(np.float64)
        first = int(np.argmax(((spread - spread.mean(axis=0)) ** 2).sum(axis=1)))  # an outlying vantage point
        top, rest = members[first], np.delete(members, first)
        self.centroid[node] = top
        away = np.sqrt(squared(self.centroids[rest], self.centroids[top]).astype(np.float64))
        order = np.argsort(away, kind="stable")
        half = (len(rest) + 1) // 2
        for side, part in enumerate((order[:half], order[half:])):
            if len(part):
                self.low[node, side], self.high[node, side] = away[part].min(), away[part].max()
                self.child[node, side] = self._grow(rest[part])
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, the smaller one of equals, and the squared distance."""
        found = [self._search(vectors[i : i + _ROWS]) for i in range(0, len(vectors), _ROWS)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([c for c, _ in found]), np.concatenate([d for _, d in found])

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        pending = np.full((n, len(self.centroid)), np.inf)  # lower bound of each node that may be opened next
        pending[:, 0] = 0
        best = np.full(n, np.iinfo(np.int64).max)
        owner = np.full(n, len(self.centroid))
        active = np.arange(n)
        while True:
            bounds = pending[active]
            node = bounds.argmin(axis=1)
            bound = bounds[np.arange(len(active)), node]
            # Inclusive: a node that can only tie may hold a smaller number.
            within = bound <= np.sqrt(best[active].astype(np.float64)) * (1 + 2.0**-50)
            active, node, bound = active[within], node[within], bound[within]
            if not len(active):
                return owner, best
            pending[active, node] = np.inf
            number = self.centroid[node]
            exact = squared(vectors[active], self.centroids[number])
            better = (exact < best[active]) | ((exact == best[active]) & (number < owner[active]))
            best[active[better]], owner[active[better]] = exact[better], number[better]
            away = np.sqrt(exact.astype(np.float64))
            for side in (0, 1):
                has = self.child[node, side] >= 0
                a, high, low = away[has], self.high[node[has], side], self.low[node[has], side]
                reach = np.maximum(np.maximum(a - high, low - a) - (a + high) * 2.0**-48, bound[has])
                pending[active[has], self.child[node[has], side]] = reach


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def _integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dims`` finite components, and those as floor(scale * x)."""
    right = np.asarray(column.value_lengths().fill_null(-1)) == dims
    flat = column.filter(pa.array(right)).flatten().fill_null(np.nan)
    values = np.asarray(flat, dtype=np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    rows = np.flatnonzero(right)[finite]
    return rows, np.clip(np.floor(values[finite] * scale), -LIMIT, LIMIT).astype(np.int32)


def _listed(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims).astype(np.int64)


def kept_vectors(vectors: DataFrame, dims: int = 64, scale: float = 256.0) -> DataFrame:
    """``id``, ``vector`` (integers) of the rows that count; written once and read by every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = _integers(batch.column(1), dims, scale)
            if len(rows):
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), _listed(values)], ["id", "vector"])

    return saved(vectors.mapInArrow(run, f"id {vectors.schema[0].dataType.simpleString()}, vector array<int>"), "vectors")


@dataclass
class Clustering:
    """``assigned``: id, cluster, distance (squared). ``centroids``: the final ones, by number."""

    assigned: DataFrame
    centroids: list[list[int]]


def cluster(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: float = 256.0,
    seed: str = "2:",
) -> Clustering:
    """Lloyd's rounds on integer vectors, exact and repeatable.

    Vectors are floor(scale * x) of each component; rows with another number of
    components, a null or a value that is not finite are left out, and so is a
    null vector. Components beyond 2**27 are set to that. The first centroids
    are the k vectors with the least SHA-256 of ``seed`` and the id (a null id
    counts as empty; rows that share an id go by their components); fewer
    vectors give fewer centroids, an empty table gives no rows. Each round moves
    a centroid to floor(sum / count) of its vectors; one without vectors stays.
    Repeated rows are vectors of their own. Other columns are not read.
    """
    spark = vectors.sparkSession
    table = kept_vectors(
        vectors.select(F.col(id_column), F.col(vector_column).cast("array<double>")), dims, scale
    )
    named = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = table.orderBy(named, "vector").limit(k).select("vector").collect()
    centroids = [list(r["vector"]) for r in first]

    def shipped():
        return spark.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64).reshape(-1, dims)))

    for _ in range(rounds if centroids else 0):
        tree = shipped()

        def totals(batches, tree=tree):
            held = tree.value
            count = np.zeros(len(held.centroids), np.int64)
            sums = np.zeros((len(held.centroids), dims), np.int64)
            for batch in batches:
                values = _matrix(batch.column(0), dims)
                owner, _ = held.nearest(values)
                order = np.argsort(owner, kind="stable")
                present, start = np.unique(owner[order], return_index=True)
                sums[present] += np.add.reduceat(values[order], start, axis=0)
                count += np.bincount(owner, minlength=len(count))
            own = np.flatnonzero(count)
            if len(own):
                yield pa.record_batch(
                    [pa.array(own.astype(np.int32)), pa.array(count[own]), _listed(sums[own])], ["cluster", "n", "sums"]
                )

        parts = table.select("vector").mapInArrow(totals, "cluster int, n bigint, sums array<bigint>")
        wide = F.col("total").cast("decimal(38,0)")
        summed = (
            parts.select("cluster", "n", F.posexplode("sums").alias("place", "total"))
            .groupBy("cluster", "place")
            .agg(F.sum(wide).alias("total"), F.sum("n").alias("n"))
        )
        moved = {(r["cluster"], r["place"]): int(r["total"]) // r["n"] for r in summed.collect()}  # k * dims rows
        centroids = [[moved.get((c, i), x) for i, x in enumerate(old)] for c, old in enumerate(centroids)]
        tree.unpersist()

    last = shipped()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, away = last.value.nearest(_matrix(batch.column(1), dims))
            yield pa.record_batch(
                [batch.column(0), pa.array(owner.astype(np.int32)), pa.array(away)], ["id", "cluster", "distance"]
            )

    shape = f"id {table.schema[0].dataType.simpleString()}, cluster int, distance bigint"
    return Clustering(saved(table.mapInArrow(assign, shape), "clusters"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """Assigned vectors with the summed distance of their cluster and of all, and their centroid as ``centroid``.

    The figures are one row per centroid, so they are broadcast. A sum beyond 64
    bits is given as the greatest 64-bit number.
    """
    spark = found.assigned.sparkSession
    most = F.lit((1 << 63) - 1)
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["cluster"]: int(r["s"]) for r in sums}
    told = [
        (c, ",".join(map(str, v)), str(by.get(c, 0)), str(sum(by.values()))) for c, v in enumerate(found.centroids)
    ]
    figures = spark.createDataFrame(told, "_c int, centroid string, own string, total string")

    def number(c: str):
        return F.least(F.col(c).cast("decimal(38,0)"), most.cast("decimal(38,0)")).cast("bigint")

    return found.assigned.join(F.broadcast(figures), F.col("cluster") == F.col("_c")).select(
        "id", "cluster", "distance", number("own").alias("cluster_inertia"), number("total").alias("inertia"), "centroid"
    )

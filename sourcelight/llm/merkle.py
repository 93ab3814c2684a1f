"""Merkle manifest of a dataset: few stored levels, proofs recomputed from them.

Leaves of one tree ascend by a key; every ``arity`` consecutive nodes become
one. Only every ``step`` levels are stored. A proof needs the siblings on all
levels: the interior nodes of each aligned subtree (at most arity ** step
stored nodes) are regenerated from the stored ones below it, each stored node
receives its siblings up to the subtree's top, and the interior is dropped.
Subtrees are worked off from the top, so each gets the path of its own top as
one row, and a tree of any size is never in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import saved

PATH = "array<struct<before:string,after:string>>"
_PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_STRETCH = 12  # rows that look up their number together: 2 to this power
_PART = 33  # monotonically_increasing_id: partition above, row below this bit


def field(value: Column) -> Column:
    """A leaf's field: its UTF-8 bytes' number, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree_key(value: Column) -> Column:
    """The tree's name as text that sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Stored ``rows`` with ``idx`` (from 0, by ``order``) in their ``tree`` and ``n``, the tree's rows.

    Rows are sorted in ranges, each range counts its rows per tree, and the
    counts before it are joined back by short stretches, so no tree, however
    large, is numbered by one task.
    """
    placed = saved(
        rows.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "merkle-order",
    )
    part = F.shiftright("_row", _PART)
    counts = placed.groupBy("tree", part.alias("part")).agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("rows"))
    line = Window.partitionBy("tree").orderBy("part")
    whole = Window.partitionBy("tree")
    offsets = counts.select(
        F.col("tree").alias("_t"), "first", (F.col("first") + F.col("rows") - 1).alias("last"),
        F.sum("rows").over(whole).alias("n"), (F.sum("rows").over(line) - F.col("rows") - F.col("first")).alias("shift"),
    )
    stretches = F.explode(F.sequence(F.shiftright("first", _STRETCH), F.shiftright("last", _STRETCH)))
    offsets = offsets.select("_t", "n", "shift", stretches.alias("_s"))  # after the windows, which count each part once
    joined = placed.join(offsets, (F.col("tree") == F.col("_t")) & (F.shiftright("_row", _STRETCH) == F.col("_s")))
    return joined.select(*rows.columns, (F.col("_row") + F.col("shift")).alias("idx"), "n")


def _up(nodes: list[str], arity: int) -> list[str]:
    return [_hash(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]


def _climb(nodes: list[str], size: int, arity: int, step: int) -> Iterator[list[str]]:
    """Levels of one aligned subtree: the nodes, then each level above, at most ``step``; the tree's root ends it."""
    yield nodes
    for _ in range(step):
        if size == 1:
            return
        nodes, size = _up(nodes, arity), -(-size // arity)
        yield nodes


@dataclass
class Forest:
    """Stored levels (0, step, 2 step, ...) of many trees: tree, n (its leaves), idx, digest; and the roots: tree, digest."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    step: int


def _size_at(leaves: Column, level: int, arity: int) -> Column:
    """Nodes of a tree on a level."""
    return F.ceil(leaves / F.lit(arity**level)).cast("bigint") if level else leaves


def _raiser(level: int, arity: int, step: int) -> Callable:
    """The node above one aligned subtree over stored nodes of ``level``."""

    def top_of(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n, block = table.column("n")[0].as_py(), table.column("idx")[0].as_py() // arity**step
        size = -(-n // arity**level)
        top = list(_climb(table.column("digest").to_pylist(), size, arity, step))[-1]
        return pa.table(
            {"tree": [table.column("tree")[0].as_py()], "n": pa.array([n], pa.int64()),
             "idx": pa.array([block], pa.int64()), "digest": top}
        )

    return top_of


def _descender(level: int, keep: list[str], arity: int, step: int) -> Callable:
    """Stored nodes of one subtree, each with its siblings below the subtree's top, then the top's own path."""

    def siblings(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("idx")
        size = -(-left.column("n")[0].as_py() // arity**level)
        higher = right.column("path")[0].as_py()
        rows = list(_climb(left.column("digest").to_pylist(), size, arity, step))
        found = []
        for at in range(left.num_rows):
            own = []
            for nodes in rows[:-1]:
                start = at - at % arity
                run = nodes[start : start + arity]
                own.append({"before": "".join(run[: at - start]), "after": "".join(run[at - start + 1 :])})
                at //= arity
            found.append(own + higher)
        roots = pa.array([right.column("root")[0].as_py()] * left.num_rows, pa.string())
        return left.select(keep).append_column("root", roots).append_column("path", pa.array(found, _PATH_TYPE))

    return siblings


def plant(leaves: DataFrame, arity: int = 2, step: int = 8) -> Forest:
    """Trees over numbered leaves (tree, n, idx, digest; stored). One job a stored level."""
    span = arity**step
    levels = [leaves.select("tree", "n", "idx", "digest")]
    done = levels[0].where("n = 1")
    shape = "tree string, n bigint, idx bigint, digest string"
    most = leaves.agg(F.max("n")).first()[0] or 0
    level = 0
    while most > 1:
        below = levels[-1].where(_size_at(F.col("n"), level, arity) > 1)
        spread = below.withColumn("block", F.floor(F.col("idx") / span))

        above = saved(spread.groupBy("tree", "block").applyInArrow(_raiser(level, arity, step), shape), "merkle-level")
        level, most = level + step, -(-most // span)
        levels.append(above)
        done = done.unionByName(above.where(_size_at(F.col("n"), level, arity) == 1))
    return Forest(levels, done.select("tree", "digest"), arity, step)


def paths(forest: Forest, tops: DataFrame, carried: DataFrame) -> DataFrame:
    """Siblings of every leaf up to its root, and on by the path that ``tops`` holds for the root.

    ``tops``: tree, root (its digest, passed on), path. ``carried``: the leaves
    (tree, n, idx, digest and further columns, all returned). Returns those,
    root and ``path``: one entry a level with the siblings before and after.
    """
    arity, step = forest.arity, forest.step
    span = arity**step
    ends = forest.levels[0].select("tree", "n").where("idx = 0").withColumnRenamed("tree", "_t")
    tops = tops.join(ends, F.col("tree") == F.col("_t")).select("tree", "n", "root", "path")
    above: DataFrame | None = None
    for place in reversed(range(len(forest.levels))):
        level = place * step
        # A tree whose root first appears on this level, or below it and above the one before, enters here.
        high, low = _size_at(F.col("n"), level, arity), _size_at(F.col("n"), max(level - step, 0), arity)
        enter = tops.where((high == 1) & ((low > 1) if place else F.lit(True))).select(
            "tree", F.lit(0).cast("bigint").alias("idx"), "root", "path"
        )
        nodes = carried if place == 0 else forest.levels[place]
        if above is not None:
            taller = nodes.where(high > 1).withColumn("block", F.floor(F.col("idx") / span))
            keep = nodes.columns if place == 0 else ["tree", "idx"]
            shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(*keep).schema)
            given = above.withColumnRenamed("idx", "block")
            down = (
                taller.groupBy("tree", "block")
                .cogroup(given.groupBy("tree", "block"))
                .applyInArrow(_descender(level, keep, arity, step), f"{shape}, root string, path {PATH}")
            )
        if place == 0:
            alone = carried.where("n = 1").join(
                enter.select(F.col("tree").alias("_t"), "root", "path"), F.col("tree") == F.col("_t")
            ).drop("_t")
            return down.unionByName(alone) if above is not None else alone
        above = enter if above is None else enter.unionByName(down)
        above = saved(above, "merkle-paths")
    raise AssertionError("a forest has at least its leaves")


@dataclass
class Manifest:
    """``proofs``: tree, the carried columns, leaf, idx, n, subroot, path. ``root``: the digest of all (None: no rows)."""

    proofs: DataFrame
    root: str | None


def manifest(
    rows: DataFrame, group: Column, order: Column, leaf: Column, carried: dict[str, Column], arity: int = 2, step: int = 8
) -> Manifest:
    """One tree per group over the leaves in ``order``, one tree over the groups' roots, and every leaf's proof.

    ``leaf`` is a leaf's digest as hex text; ``carried`` are further columns of
    the proofs. Leaves of equal order go by their digest, nulls come first; the
    groups' roots go by name, null first, bytewise. Equal rows are leaves of
    their own. A last run may hold fewer nodes; even a single one is hashed
    again. A lone leaf is its tree's root. No rows give no proofs and no root.
    """
    if arity < 2 or step < 1:
        raise ValueError("a node has at least two children, a stored level at least one level above it")
    held = saved(
        rows.select(
            _tree_key(group).alias("tree"), order.alias("_key"), leaf.alias("digest"),
            *[c.alias(name) for name, c in carried.items()],
        ),
        "merkle-leaves",
    )
    leaves = saved(numbered(held, "_key", "digest"), "merkle-numbered")
    forest = plant(leaves, arity, step)
    crowns = numbered(forest.roots.withColumnRenamed("tree", "_key").withColumn("tree", F.lit("")), "_key", "digest")
    crowns = saved(crowns, "merkle-crowns")
    crown = plant(crowns, arity, step)
    top = crown.roots.first()
    nothing = F.array().cast(PATH)
    begin = crown.roots.select("tree", F.col("digest").alias("root"), nothing.alias("path"))
    tops = paths(crown, begin, crowns).select(
        F.col("_key").alias("tree"), F.col("digest").alias("root"), "path"  # of a group's tree: its own root
    )
    proofs = paths(forest, saved(tops, "merkle-tops"), leaves)
    names = {"digest": "leaf", "root": "subroot"}
    return Manifest(
        proofs.drop("_key").withColumnsRenamed(names), top["digest"] if top else None
    )


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))

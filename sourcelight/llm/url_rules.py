"""Host and path rules for URLs as a sort-merge range join.

The canonical key of a rule is its reversed host followed by its path; the keys
that start with it form an interval, and intervals either nest or are disjoint.
A URL gives one key for each ending of its host, so that "host and all
subdomains" is equality of the host part. Keys and rules are dealt out by key
range, sorted, and swept once with a stack of the rules that are active.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE = 4096  #: keys whose quantiles give the range bounds; they place rows and never change a result
END = chr(0x10FFFF)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(at, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _key(host: Column, path: Column) -> Column:
    return F.concat(_reversed(host), F.lit("\t"), path)


def _bounds(keys: DataFrame, parts: int) -> list[str]:
    """``parts - 1`` quantiles of a uniform sample: of each of 4,096 hash classes the key with the smallest hash."""
    h = F.xxhash64("key")
    picked = keys.groupBy(F.pmod(h, F.lit(SAMPLE))).agg(F.min_by("key", h).alias("key"))
    found = sorted(r["key"][:512] for r in picked.collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _dealt(bounds: list[str], first: str, last: str | None):
    """Arrow function that adds ``part``: the range of the key, or every range an interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [bisect_right(bounds, k) for k in batch.column(first).to_pylist()]
            if last is None:
                yield batch.append_column("part", pa.array(low, pa.int32()))
                continue
            high = [bisect_right(bounds, k + END) for k in batch.column(last).to_pylist()]
            index = [i for i, (a, b) in enumerate(zip(low, high, strict=True)) for _ in range(a, b + 1)]
            parts = [p for a, b in zip(low, high, strict=True) for p in range(a, b + 1)]
            yield batch.take(pa.array(index, pa.int64())).append_column("part", pa.array(parts, pa.int32()))

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, key and kind (rules first); memory is the stack."""
    stack: list[tuple[str, str, str]] = []
    part = None
    for batch in batches:
        rows: list[tuple[str, str, str, str]] = []
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "host", "path", "rule", "verdict"))
        for p, key, kind, host, path, rule, verdict in zip(*columns, strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack:
                rows.append((host, path, stack[-1][1], stack[-1][2]))
        names = ("host", "path", "rule", "verdict")
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=list(names)
        )


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct (host, path) that has one: host, path, rule, verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains
    when the path starts with the rule's. The longest rule (host and path
    together) wins, then the longer host; of equal rules the one that blocks.
    """
    clean = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    clean = saved(clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    depths = [r[0] for r in clean.select(F.size(F.split("host", r"\.", -1))).distinct().collect()]
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    ends = F.filter(F.array(*[F.lit(d) for d in sorted(depths)]), lambda d: d <= n)
    distinct = addresses.select("host", "path").distinct()
    end = F.slice("_labels", F.col("_n") - F.col("_d") + 1, F.col("_d"))
    keys = (
        distinct.select("host", "path", labels.alias("_labels"), n.alias("_n"), F.explode(ends).alias("_d"))
        .select("host", "path", F.concat(F.array_join(F.reverse(end), "."), F.lit("\t"), "path").alias("key"))
    )
    keys = saved(keys, "url-keys")
    parts = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(keys, parts)
    starts = clean.select(
        _key(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("kind"), "host", "path",
        F.concat("host", "path").alias("rule"), "verdict",
    )
    asked = keys.select(
        "key", F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    shape = "key string, kind int, host string, path string, rule string, verdict string, part int"
    both = asked.mapInArrow(_dealt(bounds, "key", None), shape).unionByName(
        starts.mapInArrow(_dealt(bounds, "key", "key"), shape)
    )
    swept = (
        both.repartition(parts, "part")
        .sortWithinPartitions("part", "key", "kind")
        .mapInArrow(_sweep, "host string, path string, rule string, verdict string")
    )
    rule_host = F.length(F.regexp_extract("rule", "^[^/]*", 0))
    best = F.max(F.struct(F.length("rule").alias("n"), rule_host.alias("h"), "rule", "verdict")).alias("best")
    return swept.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict on every page: page_id, url, host, path, rule (null without one), verdict.

    Pages without a fitting rule, with a null url or without ``://`` get the
    default verdict. Repeated rows stay as many rows as they were; other columns
    are ignored.
    """
    asked = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    won = matched_rules(asked, rules)
    return asked.join(won, ["host", "path"], "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )

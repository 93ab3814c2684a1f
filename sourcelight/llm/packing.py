"""Best-fit decreasing packing of token sequences.

Texts are tokenized where they lie. Pieces of one length are interchangeable,
so the packing needs no more than the number of pieces of each length, at most
``size`` counts whatever the corpus: they are placed on the driver, longest
first, each into the tightest open bin, which a segment tree over remaining
capacities finds in logarithmic time. A run of equal pieces and equal bins is
placed in one step, with the result of placing them one by one. The runs are
then joined to the pieces by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import salt, saved, whole_text

SIZE = 1024
END_ID = 2
SLICES = 1024  #: hash slices in which equally long pieces are ranked
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Texts that hold a special token's string, or white space long enough to exhaust a backtracking matcher.
LONG_SPACE = re.compile(r"\s{2000}")


class Encoder:
    """Token ids of the ``tokenizers`` file ``path``.

    ``ranks`` (a tiktoken file of the same vocabulary) is an optional faster
    way to the same ids; texts on which the two could differ go through
    ``tokenizers`` itself. The word pattern is given with the ranks.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            with open(path, encoding="utf-8") as file:
                added = [t["content"] for t in json.load(file).get("added_tokens", [])]
            self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_SPACE.search(text) or (self.special and self.special.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


def piece_lengths(total: int, size: int = SIZE) -> list[int]:
    """All pieces are full but the first, which takes the rest."""
    if total <= size:
        return [total]
    first = total % size
    return ([first] if first else []) + [size] * (total // size)


def _cut(encoder_args: tuple, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*encoder_args)
        for batch in batches:
            out: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(END_ID)).astype("<u4")
                start = 0
                for piece, length in enumerate(piece_lengths(len(ids), size)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, encoder_args: tuple, size: int = SIZE) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. Null text counts as empty: one piece, the end id."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(_cut(encoder_args, size), PIECES)


@dataclass(frozen=True)
class Run:
    """Pieces of one length, from rank ``first`` on, go ``per_bin`` each into bins from ``bin`` on, at ``offset``."""

    length: int
    first: int
    count: int
    bin: int
    per_bin: int
    offset: int


class CapacityTree:
    """Segment tree over capacities 0..size: which capacities have an open bin."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [False] * (2 * self.width)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.width
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest open capacity of at least ``need``."""
        i = need + self.width
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], size: int = SIZE) -> list[Run]:
    """Placement of ``counts[length]`` pieces of each length; work depends on the number of lengths, not of pieces."""
    tree = CapacityTree(size)
    bins: dict[int, list[tuple[int, int]]] = {}  # capacity left -> (first bin, number of bins)
    runs: list[Run] = []
    used = 0

    def put_back(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            bins.setdefault(capacity, []).append((first, count))
            tree.mark(capacity, True)

    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = size, used, -(-left // (size // length))
                used += count
            else:
                first, count = bins[capacity].pop()
                if not bins[capacity]:
                    tree.mark(capacity, False)
            each = capacity // length
            full = min(count, left // each)
            if full:
                runs.append(Run(length, rank, full * each, first, each, size - capacity))
                put_back(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer pieces than one bin takes
                runs.append(Run(length, rank, left, first + full, left, size - capacity))
                put_back(capacity - left * length, first + full, 1)
                put_back(capacity, first + full + 1, count - full - 1)
                left = 0
            elif full < count:
                put_back(capacity, first + full, count - full)
    return runs


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Place pieces (as from ``pieces``, read more than once): adds sequence_id and offset.

    Equal pieces of repeated rows are pieces of their own.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = best_fit_decreasing(counts, size)
    plan = spark.createDataFrame(
        [(r.length, r.first, r.first + r.count, r.bin, r.per_bin, r.offset) for r in runs],
        "_length bigint, _first bigint, _end bigint, _bin bigint, _each bigint, _offset bigint",
    )
    sliced = cut.withColumn("_slice", salt(SLICES, "doc_id", "piece"))
    per = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        F.col("length").alias("_l"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before")
    )
    inner = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece")
    ranked = sliced.withColumn("_in", F.row_number().over(inner))
    ranked = ranked.join(per, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s"))).withColumn(
        "_rank", F.col("_before") + F.col("_in") - 1
    )
    # Runs of a length are few (bounded by the number of capacities), so a row meets few of them.
    there = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    at = (F.col("_rank") - F.col("_first"))
    return ranked.join(F.broadcast(plan), there).select(
        *cut.columns,
        (F.col("_bin") + F.floor(at / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, encoder_args: tuple, size: int = SIZE) -> DataFrame:
    """Tokenize, cut and pack all documents; one row per piece.

    Only doc_id and text are read. Empty and null texts are one end id; a null
    doc_id and repeated rows are documents like others; an empty table gives no
    rows. The broadcast plan has at most a run per pair of lengths and
    capacities, whatever the number of documents.
    """
    return pack(saved(pieces(docs, encoder_args, size), "packing-pieces"), size)

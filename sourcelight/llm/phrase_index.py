"""Positional inverted index of a training corpus, and test passages sought in it.

The index is cut by documents into segments of bounded size. A segment holds one
row per term: its postings, ``ordinal << 32 | word position``, in order. So a
term of any frequency is spread over all segments, and all postings of one
document lie together. Words are cut and numbered in arrays over the bytes of a
batch; no word is a Python object.

A passage is sought as windows of consecutive words. In each segment that holds
its rarest terms, the postings of a window's terms, shifted by their place in
it, are intersected from the rarest term on, until none is left or all agree
(exact phrase); or, without order, all terms must stand close to the rarest one
(proximity).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import saved

#: Words after which a segment is closed. A longer document has one of its own.
SEGMENT_WORDS = 1_000_000
_ROWS = 20_000
#: Windows that are sought in a segment by one call.
WINDOWS_A_CALL = 50_000

#: Bytes of words: 0-9, A-Z, a-z and all of other scripts; A-Z are lower-cased.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

INDEX_SHAPE = "segment bigint, term string, n bigint, postings array<bigint>, ids array<string>"
WINDOW_SHAPE = "segment bigint, ordinal bigint, item string, start bigint, stop bigint"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in order, and how many each text has. Null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = word[heads]  # a word ends with its text
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    kept = np.cumsum(word)  # word bytes up to here, this one included
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0)
    packed = _LOWER[data[word]]
    terms = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]
    )
    return terms, counts


class _Segment:
    """Words of documents until a segment is full."""

    def __init__(self) -> None:
        self.terms: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.size = 0

    def add(self, ids: pa.Array, terms: pa.Array, counts: np.ndarray) -> None:
        self.ids.append(ids)
        self.terms.append(terms)
        self.counts.append(counts)
        self.size += len(terms)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """One row per term, and one of a null term with the words and ids of the documents."""
        counts = np.concatenate(self.counts)
        terms = pa.chunked_array(self.terms).combine_chunks().dictionary_encode()
        codes = np.asarray(terms.indices)
        ordinals = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.argsort(codes, kind="stable")
        postings = (ordinals[order] << 32) | places[order]
        n = np.bincount(codes, minlength=len(terms.dictionary))
        yield self._batch(number, terms.dictionary.cast(pa.string()), n, postings, None)
        ids = pa.chunked_array(self.ids).combine_chunks()
        yield self._batch(number, pa.nulls(1, pa.string()), np.array([len(counts)]), counts, ids)

    @staticmethod
    def _batch(number: int, terms: pa.Array, n: np.ndarray, values: np.ndarray, ids: pa.Array | None) -> pa.RecordBatch:
        offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        held = pa.nulls(len(terms), pa.list_(pa.string())) if ids is None else (
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        )
        columns = [
            pa.array(np.full(len(terms), number, np.int64)), terms, pa.array(n.astype(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int64))), held,
        ]
        return pa.record_batch(columns, ["segment", "term", "n", "postings", "ids"])


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of ``docs`` as a stored table: segment, term, n, postings, ids.

    Rows of a null term list the documents of a segment: words of each
    (``postings``) and ids as text (``ids``). Every row is a document of its
    own, also if its id is null or repeated. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        segment = _Segment()
        for batch in batches:
            terms, counts = words_of(batch.column(1))
            ids = batch.column(0)
            done = np.append(0, np.cumsum(counts))
            start = 0
            while start < len(ids):
                room = max(segment_words - segment.size, 0)
                stop = int(np.searchsorted(done, done[start] + room, side="right")) - 1
                stop = max(stop, start + (not segment.size))
                if stop > start:
                    segment.add(ids[start:stop], terms[done[start] : done[stop]], counts[start:stop])
                    start = stop
                if start < len(ids):
                    yield from segment.rows(number)
                    number, segment = number + 1, _Segment()
        if segment.ids:
            yield from segment.rows(number)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            for start in range(0, batch.num_rows, _ROWS):
                yield batch.slice(start, _ROWS)

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    return saved(rows.mapInArrow(short, INDEX_SHAPE), "phrase-index", compression="zstd")


def indexed_documents(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """segment, ordinal, id, n_words of every document."""
    held = index.where(F.col("term").isNull()).select(
        "segment", F.posexplode(F.arrays_zip("ids", "postings")).alias("ordinal", "d")
    )
    return held.select(
        "segment", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("d.ids").cast(id_type).alias("id"),
        F.col("d.postings").alias("n_words"),
    )


def item_words(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item (its id as text, a null one as empty), no (a number of the row), words; only rows that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            terms, counts = words_of(batch.column(1))
            has = pa.array(counts > 0)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            words = pa.ListArray.from_arrays(offsets, terms.cast(pa.string()))
            numbers = pa.array(np.arange(number, number + len(counts)))
            number += len(counts)
            yield pa.record_batch([batch.column(0), numbers, words], ["item", "no", "words"]).filter(has)

    named = items.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).cast("string").alias("text")
    )
    return saved(named.mapInArrow(run, "item string, no bigint, words array<string>"), "phrase-items")


def _rarity(terms: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the corpus frequency of each of their words (0: nowhere)."""
    placed = items.select("no", F.posexplode("words").alias("p", "term"))
    known = terms.groupBy(F.col("term").alias("_t")).agg(F.sum("n").alias("cf"))  # frequent terms combine before the shuffle
    counted = placed.join(known, F.col("term") == F.col("_t"), "left")
    # One row per item, as long as its text.
    lists = counted.groupBy("no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("p", F.coalesce("cf", F.lit(0)).alias("cf")))), lambda x: x["cf"]
        ).alias("cfs")
    )
    return items.join(lists.withColumnRenamed("no", "_no"), F.col("no") == F.col("_no")).drop("_no")


def windows_of(words: list[str], cfs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Windows (start, end) whose words all occur in the corpus; a shorter passage is one window."""
    width = min(size, len(words))
    gaps = np.append(0, np.cumsum(cfs == 0))
    starts = np.flatnonzero(gaps[width:] == gaps[:-width])
    return [(int(s), int(s) + width) for s in starts]


def _anchors(items: DataFrame, size: int) -> DataFrame:
    """no, term: the rarest term of every window that can occur at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nos, terms = [], []
            for row in batch.to_pylist():
                cfs = np.array(row["cfs"])
                rare = {row["words"][a + int(np.argmin(cfs[a:b]))] for a, b in windows_of(row["words"], cfs, size)}
                nos += [row["no"]] * len(rare)
                terms += sorted(rare)
            yield pa.record_batch([pa.array(nos, pa.int64()), pa.array(terms, pa.string())], ["no", "_t"])

    return items.select("no", "words", "cfs").mapInArrow(run, "no bigint, _t string")


def _member(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def exact_phrases(lists: dict, words: list, cfs: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(ordinal, first word, words) of each window's occurrences in one segment.

    Posting lists shifted by the term's place agree where the phrase starts.
    Neighbouring windows mostly share their two rarest terms, so that first
    intersection is kept for the next window.
    """
    last: tuple = ()
    common = np.zeros(0, np.int64)
    for a, b in windows_of(words, cfs, size):
        order = a + np.argsort(cfs[a:b], kind="stable")
        if any(words[p] not in lists for p in order):
            continue
        pair = tuple(order[:2])
        if pair != last:
            # Postings minus the place in the passage: equal for all words of one occurrence.
            last, common = pair, lists[words[order[0]]] - order[0]
            if len(order) > 1:
                common = common[_member(lists[words[order[1]]], common + order[1])]
        left = common
        for p in order[2:]:
            if not len(left):
                break
            left = left[_member(lists[words[p]], left + p)]
        if len(left):
            starts = left + a
            yield starts >> 32, starts & 0xFFFFFFFF, b - a


def near_phrases(reach: int) -> Callable:
    """Windows whose words all stand within ``reach`` words of an occurrence of the rarest one, in any order."""

    def seek(lists: dict, words: list, cfs: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for a, b in windows_of(words, cfs, size):
            order = a + np.argsort(cfs[a:b], kind="stable")
            if any(words[p] not in lists for p in order):
                continue
            left = lists[words[order[0]]]
            for word in dict.fromkeys(words[p] for p in order[1:]):
                held = lists[word]
                floor = np.maximum(left & 0xFFFFFFFF, reach) - reach | left >> 32 << 32  # not before the document
                at = np.searchsorted(held, floor)
                there = held[np.minimum(at, len(held) - 1)]
                left = left[(at < len(held)) & (there <= left + reach)]
                if not len(left):
                    break
            if len(left):
                place = left & 0xFFFFFFFF
                start = np.maximum(place, reach) - reach
                yield left >> 32, start, place + reach + 1 - start

    return seek


def occurrences(index: DataFrame, items: DataFrame, size: int = 10, seek: Callable = exact_phrases) -> DataFrame:
    """Stretches of documents that windows of the items cover: segment, ordinal, item, start, stop (words, end exclusive).

    ``items``: rows of ``item_words``. Windows that follow one another in the
    passage and in the document are one stretch. An item is sought only in
    segments that hold the rarest term of one of its windows; a segment takes at
    most about ``WINDOWS_A_CALL`` windows per call, more items are dealt to more
    calls.
    """
    total = items.agg(F.sum(F.greatest(F.size("words") - size + 1, F.lit(1)))).first()[0] or 0
    calls = -(-total // WINDOWS_A_CALL) or 1
    call = F.pmod(F.xxhash64("no"), F.lit(calls)).cast("int")
    # Stored, so the optimizer knows its size: a short list goes to the scan of the index, a long one is merged.
    wanted = saved(items.select(call.alias("call"), F.explode("words").alias("_t")).distinct(), "phrase-terms")
    held = index.where(F.col("term").isNotNull())
    terms = held.select("segment", "term", "n").join(wanted.select("_t").distinct(), F.col("term") == F.col("_t"), "left_semi")
    rated = saved(_rarity(terms, items), "phrase-rarity")
    where = terms.select("segment", "term").join(_anchors(rated, size).distinct(), F.col("term") == F.col("_t"))
    sought = where.select("segment", F.col("no").alias("_no")).distinct()
    asked = rated.join(sought, F.col("no") == F.col("_no")).select(
        F.col("segment").alias("segment"), call.alias("call"), "item", "words", "cfs"
    )
    given = held.join(wanted, F.col("term") == F.col("_t")).select("segment", "call", "term", "postings")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            column = left.column("postings").combine_chunks()
            flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
            lists = {t: flat[ends[i] : ends[i + 1]] for i, t in enumerate(left.column("term").to_pylist())}
            for row in right.to_pylist():
                found += [(row["item"], *s) for s in _stretches(seek(lists, row["words"], np.array(row["cfs"]), size))]
        segment = left.column("segment")[0].as_py() if left.num_rows else 0
        o, s, e = (pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3))
        return pa.table(
            {"segment": pa.array([segment] * len(found), pa.int64()), "ordinal": o,
             "item": pa.array([f[0] for f in found], pa.string()), "start": s, "stop": e}
        )

    keys = ("segment", "call")
    return given.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, WINDOW_SHAPE)


def _stretches(found: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple[int, int, int]]:
    """Occurrences that touch within a document as one stretch each."""
    parts = [np.stack([o, s, s + n], axis=1) for o, s, n in found]
    if not parts:
        return
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    for ordinal, group in groupby(rows.tolist(), key=lambda r: r[0]):
        begin = end = None
        for _, a, b in group:
            if end is not None and a <= end:
                end = max(end, b)
            else:
                if end is not None:
                    yield ordinal, begin, end
                begin, end = a, b
        yield ordinal, begin, end


def hits_per_document(found: DataFrame) -> DataFrame:
    """segment, ordinal, n_hit (words in any stretch), items (distinct ids as text, sorted)."""
    line = Window.partitionBy("segment", "ordinal").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("stop").over(line), F.lit(0))
    fresh = F.greatest(F.col("stop") - F.greatest("start", before), F.lit(0))
    covered = found.select("*", fresh.alias("fresh"))
    return covered.groupBy("segment", "ordinal").agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )


def contaminated(
    docs: DataFrame, items: DataFrame, size: int = 10, seek: Callable = exact_phrases, segment_words: int = SEGMENT_WORDS
) -> DataFrame:
    """Every row of ``docs`` with the words and items found in it: doc_id, n_words, n_hit, items.

    A document word is hit if any occurrence of a window of an item covers it.
    Windows are ``size`` consecutive words; an item of fewer is one window, one
    without words (or null) none. Items that share an id are one item with
    several texts; a null item id counts as an empty one. Null texts have no
    words, empty tables give no rows or no hits. Repeated rows, and rows of a
    null doc_id, are documents of their own. Other columns are not read.
    """
    index = build_index(docs, segment_words=segment_words)
    found = saved(occurrences(index, item_words(items), size, seek), "phrase-hits")
    hits = hits_per_document(found).select(
        F.col("segment").alias("_s"), F.col("ordinal").alias("_o"), "n_hit", "items"
    )
    rows = indexed_documents(index, docs.schema["doc_id"].dataType.simpleString())
    joined = rows.join(hits, (F.col("segment") == F.col("_s")) & (F.col("ordinal") == F.col("_o")), "left")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )

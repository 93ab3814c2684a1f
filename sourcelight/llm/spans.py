"""Removal of repeated passages by sliding spans of sentences.

Sentences end at their marks and at line ends, and are the units that go or
stay. Only a sentence of more than 24 words is cut further, after the words
whose hash (with the word before) is the least of some eight neighbours: where
such a cut falls depends on the words around it alone, so cuts agree in any
passage that two texts share. A span is a run of at least three consecutive
units with at least 15 words, where a word of a cut sentence counts half (within
one of those a span has 30 words), or of fewer units with at least 30 words. So
a passage of 51 words has a span wherever it starts and ends, but for few that
lie badly. Spans are the shortest one that starts at a
unit and the shortest one that ends at it, so a repeated passage is covered up
to the outermost whole sentences (or common cuts). Spans are hashed and joined
globally, and units covered by any span that is not the first of its hash are
removed. The first is the one with the smallest doc_id, then position. In
scripts without spaces between words, two characters count as one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelight.llm.common import saved, whole_text

SENTENCES, WORDS, WINDOW, LONG = 3, 15, 8, 24
ENOUGH = 30  #: words that make a span of fewer units
#: Thai to Burmese, Khmer, CJK with its signs, kana and wide forms: written without spaces, each character is cut off.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uffdc\U00020000-\U0003134f"
SPACE, ALONE, MARK, LINE, WIDE = 1, 2, 4, 8, 16


def _kinds() -> np.ndarray:
    """Of each code point: white space, written without spaces, and what ends a sentence.

    A sentence ends at a mark with white space after it, at a line's end, and at wide marks.
    """
    kinds = np.zeros(0x110000, np.uint8)
    for first, last in zip(_SINGLE[::3], _SINGLE[2::3], strict=True):
        kinds[ord(first) : ord(last) + 1] = ALONE
    kinds[[c for c in range(0x3001) if chr(c).isspace()]] = SPACE
    for chars, kind in ((".!?", MARK), ("\n", LINE), ("\u3002\uff01\uff1f\uff61", WIDE)):
        kinds[[ord(c) for c in chars]] |= kind
    return kinds


_KINDS = _kinds()
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """Hash of each word by its spelling in the text; case does not count."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace"))
        return value


_HASHES = _Hashes()
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            _POWERS[i] = np.cumprod(line, dtype=np.uint64)
    return _POWERS


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def _read(text: str, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Of each word: where it ends with the white space after it, its hash, whether a unit ends there, and its two weights.

    Without ``hashed`` only the words of sentences that are to be cut are hashed.

    Weights are quarters of a word: half for a character of a script without
    spaces, and in the second half of that again in a sentence that is cut.
    """
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KINDS[codes]
    space = (kinds & SPACE).view(bool)
    alone = (kinds & ALONE) != 0
    single = bool(alone.any())
    first = ~space
    first[1:] &= space[:-1] | alone[1:] | alone[:-1] if single else space[:-1]
    begin = np.flatnonzero(first)
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(text))
    follows = space[1:] | first[1:] if single else space[1:]
    tail = np.flatnonzero(~space & np.append(follows, True))  # last character of each word
    stop = (kinds[tail] & MARK != 0) & (ends > tail + 1)
    lines = np.searchsorted(begin, np.flatnonzero(kinds & LINE), side="right") - 1
    stop[lines[lines >= 0]] = True
    if single:
        wide = np.append(kinds & WIDE != 0, False)
        stop |= wide[tail] & ~wide[tail + 1]  # the last of a run of wide marks
    same = ~stop[:-1]
    sentence = np.concatenate([[0], np.cumsum(stop[:-1])])
    weight = np.full(n, 4, np.int64)
    if single:
        weight[alone[begin]] = 2
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.add.reduceat(weight, starts)
    cuttable = size > 4 * LONG
    long = np.repeat(cuttable, np.diff(np.append(starts, n)))
    less = np.where(long, weight // 2, weight)
    hashes = np.zeros(n, np.uint64)
    wanted = np.ones(n, bool) if hashed else long
    if single:
        words = [text[a:b] for a, b in zip(begin[wanted].tolist(), (tail[wanted] + 1).tolist(), strict=True)]
    elif hashed:
        words = text.split()
    else:
        last = np.append(starts[1:], n) - 1
        words = []
        for a, b in zip(begin[starts[cuttable]].tolist(), ends[last[cuttable]].tolist(), strict=True):
            words += text[a:b].split()
    hashes[wanted] = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    cut = np.zeros(n, bool)
    if cuttable.any():
        value = hashes.copy()
        value[1:] += _mixed(hashes[:-1]) * same
        value = _mixed(value)
        # the least of each window within a sentence; a word is cut after if it is the least of any window around it
        least = value
        for s in (1, 2, 4):
            least = np.minimum(least[s:], least[:-s])
        most = np.zeros(n + WINDOW - 1, np.uint64)
        most[WINDOW - 1 : n] = least * (sentence[WINDOW - 1 :] == sentence[: 1 - WINDOW])
        for s in (1, 2, 4):
            most = np.maximum(most[s:], most[:-s])
        cut = (most == value) & long
    cut[:-1] |= ~same
    cut[-1] = True
    return ends, hashes, cut, weight, less


def _stops(text: str) -> np.ndarray:
    """End of each unit; white space alone is one unit."""
    ends, _, cut, *_ = _read(text, hashed=False)
    return ends[cut] if len(ends) or not text else np.array([len(text)])


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each unit; together they cover the text."""
    stops = _stops(text).tolist()
    return list(zip([0, *stops[:-1]], stops, strict=True)) if stops else []


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All spans in text order: first piece << 32 | last piece, and the hash of the words."""
    _, hashes, cut, weight, less = _read(text)
    at = np.concatenate([[0], np.flatnonzero(cut) + 1])  # words before each piece
    n = len(at) - 1
    full, upto = (np.concatenate([[0], np.cumsum(w)])[at] for w in (weight, less))
    piece = np.arange(n)
    # last piece of the shortest span from each start, first piece of the shortest span to each end
    last = np.maximum(np.searchsorted(upto, upto[:n] + 4 * WORDS) - 1, piece + SENTENCES - 1)
    last = np.minimum(last, np.searchsorted(full, full[:n] + 4 * ENOUGH) - 1)
    first = np.minimum(np.searchsorted(upto, upto[1:] - 4 * WORDS, side="right") - 1, piece - SENTENCES + 1)
    first = np.maximum(first, np.searchsorted(full, full[1:] - 4 * ENOUGH, side="right") - 1)
    ahead = last < n
    back = (first >= 0) & (last[first] != piece)
    pairs = np.sort(np.concatenate([(piece << 32 | last)[ahead], (first << 32 | piece)[back]]))
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    power, inverse = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return pairs, _mixed((sums[at[j + 1]] - sums[at[i]]) * inverse[at[i]]).view(np.int64)


def spans(text: str, cuts: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(first piece, last piece, hash of the words) of all spans. White space and case do not count. ``cuts`` follow from the text."""
    pairs, values = _spans(text)
    return list(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), values.tolist(), strict=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans with their first and last piece in one number; ``again`` if the document held the same words before."""
    for batch in batches:
        found = [_spans(text.as_py()) for text in batch.column(1)]
        again = [np.ones(len(v), bool) for _, v in found]
        for (_, values), flags in zip(found, again, strict=True):
            flags[np.unique(values, return_index=True)[1]] = False
        whose = np.repeat(np.arange(len(found)), [len(v) for _, v in found])
        docs = batch.column(0).take(pa.array(whose, pa.int64()))
        pairs, values = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        flags = np.concatenate([np.zeros(0, bool), *again])
        yield pa.RecordBatch.from_arrays(
            [docs, pa.array(values), pa.array(pairs), pa.array(flags)], names=["doc", "hash", "span", "again"]
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text", "n_sentences", "n_removed", "removed_chars"]
    for batch in batches:
        covered = batch.column(2)
        spans_of, upto = covered.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(covered), 0))
        out: list[tuple] = []
        for text, low, high in zip(batch.column(1), np.append(0, upto[:-1]).tolist(), upto.tolist(), strict=True):
            t = text.as_py()
            stops = _stops(t)
            n, kept, dropped = len(stops), t, 0
            if high > low:
                ranges = spans_of[low:high]
                # another text of the same doc_id may have more units
                marks = (np.minimum(ranges >> 32, n), np.minimum((ranges & 0xFFFFFFFF) + 1, n))
                gone = np.bincount(marks[0], minlength=n + 1) - np.bincount(marks[1], minlength=n + 1)
                dead = np.cumsum(gone)[:-1] > 0
                dropped = int(dead.sum())
                at = np.append(0, stops)
                # neighbouring units that stay are one slice
                turns = np.flatnonzero(np.diff(np.concatenate([[True], dead, [True]])))
                kept = "".join([t[a:b] for a, b in at[turns].reshape(-1, 2).tolist()])
            out.append((kept, n, dropped, len(t) - len(kept)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans that are not the first of their hash: doc, ranges (array of spans). ``docs``: doc_id, text.

    What a document repeats of itself is known where it is read; between
    documents all but the least doc_id repeat. Least ids and counts of a hash
    combine map-side, and only hashes that occur again go into the join, a
    plain merge join whose hot keys are split at run time.
    """
    found = saved(docs.mapInArrow(_hashed, "doc bigint, hash bigint, span bigint, again boolean"), "span-hashes")
    once = found.where("not again and doc is not null").select("doc", "hash", "span")
    repeated = once.groupBy("hash").agg(F.min("doc").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = saved(repeated.select(F.col("hash").alias("_h"), "origin"), "span-repeated").hint("merge")
    later = once.join(repeated, F.col("hash") == F.col("_h")).where("doc > origin").select("doc", "span")
    own = found.where("again").select("doc", "span")
    return later.unionByName(own).groupBy("doc").agg(F.collect_set("span").alias("ranges"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """Texts without sentences that an earlier place already holds: doc_id, text, n_sentences, n_removed (both of units), removed_chars.

    Null text counts as empty; rows equal in doc_id and text are cut alike, as one document.
    Rows of a null doc_id lose only what their own text repeats, and no other document loses what they hold. Rows that share
    a doc_id but not the text are cut by each other's repeats. Texts of fewer
    than 15 words, or of one or two units without 30, have no span. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    later = repeated_spans(rows)
    both = rows.join(later.hint("merge"), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(
        _cleaned, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, removed_chars bigint"
    )

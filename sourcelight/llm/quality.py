"""Quality by vote of the nearest labelled texts in a latent semantic space.

Terms are triples of character classes (letters, capitals, digits, kinds of
punctuation) and how words repeat; they say how a text is written, in any
language. A bounded sample of labelled documents is weighted (square root of
shares, inverse document frequency), reduced to its leading singular directions
and broadcast. Every document is projected alike and meets all labelled vectors
as blocked cosine products; its nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.llm.common import whole_text

TERMS = 2048
EXTRA = 3  #: words like the one before, other words, words that came before
EXTRA_WEIGHT = 3.0
BLOCK = 256  #: documents of one product


def _classes() -> np.ndarray:
    """Character class of each byte; bytes of other than ASCII characters count as small letters."""
    kinds = np.full(256, 15, dtype=np.int64)
    for n, characters in enumerate(
        ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "\"'",
         "()[]{}<>", "|", "#$%&*@~^=+/\\_`", "-"), start=1
    ):
        kinds[[ord(c) for c in characters]] = n
    kinds[128:] = 1
    return kinds


CLASSES = _classes()
#: Triples of classes (16 ** 3) folded into the terms.
FOLDED = (np.arange(4096) * 2654435761 >> 7) % TERMS


def term_counts(text: str) -> np.ndarray:
    counts = np.zeros(TERMS + EXTRA, dtype=np.float32)
    kinds = CLASSES[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    if len(kinds) > 2:
        triples = FOLDED[kinds[:-2] * 256 + kinds[1:-1] * 16 + kinds[2:]]
        counts[:TERMS] = np.bincount(triples, minlength=TERMS)
    words = text.lower().split()
    if len(words) > 1:
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        counts[TERMS:] = EXTRA_WEIGHT * np.array([same, len(words) - same, len(words) - len(set(words))])
    return counts


def shares(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    """What is broadcast: term weights, directions, and at most the sampled number of labelled vectors."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the vote; 0 for texts without terms, 0.5 if nothing is labelled.

        All vectors as similar as the last neighbour vote, so ties do not depend on an order.
        """
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        here = unit(unit(shares(counts) * self.idf) @ self.directions)
        near = np.round(here @ self.vectors.T, 5)
        k = min(self.neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
        row, column = np.nonzero((near >= least) & (near > 0))
        vote = near[row, column].astype(np.float64) ** self.sharpness
        total = np.bincount(row, vote, minlength=len(near))
        good = np.bincount(row, vote * self.labels[column], minlength=len(near))
        return np.where(total > 0, np.clip(good / np.maximum(total, 1e-300), 0, 1), 0.0)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text modulo 4; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def held_out() -> Column:
    return remainder() == 2


def _sampled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(t.as_py()) for t in batch.column(0)]
        terms = [np.flatnonzero(c).astype(np.int32) for c in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.list_(pa.int32())),
                pa.array([c[t] for c, t in zip(found, terms, strict=True)], pa.list_(pa.float32())),
                batch.column(1), batch.column(2),
            ],
            names=["terms", "counts", "label", "place"],
        )


def train(
    docs: DataFrame, labels: DataFrame, per_label: int = 2000, dimensions: int = 48, neighbours: int = 16, sharpness: float = 8.0
) -> Model:
    """Model from at most ``per_label`` documents of each quality, those first in a hash order of doc_id.

    Rows whose remainder is 2 are never used, nor unlabelled, null or other
    labels; of rows that share a doc_id, one text is learnt from. The sample
    bounds the driver's matrices, whatever the tables hold.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()
    )
    place = F.xxhash64("doc_id")
    picked = [
        known.where(F.col("label") == n).distinct().orderBy(place, "doc_id").limit(per_label) for n in (0, 1)
    ]
    sample = picked[0].unionByName(picked[1]).toDF("_id", "label").withColumn("place", F.xxhash64("_id"))
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # One row per id and label, whatever a table repeats; the least hash combines before the shuffle.
    rows = rows.groupBy("_id", "label", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    told = rows.select("text", "label", "place").mapInArrow(
        _sampled_counts, "terms array<int>, counts array<float>, label int, place bigint"
    ).toArrow().combine_chunks()
    sizes = told["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    terms, values = (told[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
    found, place = told["label"].to_numpy(), told["place"].to_numpy()
    weight = np.array([values[x:y].sum() for x, y in zip(ends[:-1], ends[1:], strict=True)])
    order = np.lexsort((weight, sizes, found, place))
    counts = np.zeros((len(order), TERMS + EXTRA), dtype=np.float32)
    for i, row in enumerate(order):
        counts[i, terms[ends[row] : ends[row + 1]]] = values[ends[row] : ends[row + 1]]
    known_labels = found[order].astype(np.float32)
    idf = (np.log((len(order) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.1).astype(np.float32)
    weighted = counts  # in place: the driver holds one such matrix
    weighted /= np.maximum(weighted.sum(axis=1, keepdims=True), 1)
    np.sqrt(weighted, out=weighted)
    weighted *= idf
    weighted /= np.maximum(np.sqrt(np.einsum("ij,ij->i", weighted, weighted))[:, None], 1e-9)
    directions = np.linalg.eigh(weighted.T @ weighted)[1][:, ::-1][:, :dimensions].astype(np.float32)
    vectors = unit(weighted @ directions).astype(np.float32)
    return Model(idf, directions, vectors, known_labels, neighbours, sharpness)


def scorer(docs: DataFrame, model: Model):
    """Function of a text column: the score of each whole text, six digits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.empty(len(texts))
            values = texts.tolist()
            for i in range(0, len(values), BLOCK):
                counts = np.stack([term_counts(t) for t in values[i : i + BLOCK]])
                out[i : i + BLOCK] = shared.value.scores(counts)
            yield pd.Series(np.round(out, 6))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    doc_id, lang, source and labels never enter a score. Null text counts as
    empty; empty texts score 0; repeated rows stay as many as they were; empty
    tables give no rows, or 0.5 everywhere without labels. Other columns are
    ignored.
    """
    score = scorer(docs, train(docs, labels, **parameters))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(whole_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **parameters) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, columns unchanged. Without any labels all rows stay."""
    model = train(docs, labels, **parameters)
    return docs.where(scorer(docs, model)(whole_text()) >= threshold) if len(model.labels) else docs

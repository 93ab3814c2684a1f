"""Batches are worked off in slices of bounded size, with the same figures."""

import numpy as np
import pyarrow as pa

from sourcelight.functions import hashing, html
from sourcelight.functions.batches import runs
from sourcelight.operators import cells


def test_runs_hold_few_bytes():
    texts = pa.array(["x" * 10, None, "y" * 30, "", "z" * 10, "é" * 6])
    assert list(runs(texts, 20)) == [(0, 2), (2, 1), (3, 2), (5, 1)]
    assert list(runs(texts.slice(3), 20)) == [(0, 2), (2, 1)]
    assert list(runs(texts.slice(0, 0), 20)) == []


def test_features_are_counted_in_slices(monkeypatch):
    words = [["alpha", "beta"], [], ["beta"] * 5, ["gamma"], ["alpha"]]
    tokens, texts = pa.array(words, pa.list_(pa.string())), pa.array(["".join(w) for w in words])
    whole = hashing.signed_counts(tokens, texts, 16)
    seen, count = [], hashing._slice_counts
    monkeypatch.setattr(hashing, "SLICE_BYTES", 10)
    monkeypatch.setattr(hashing, "_slice_counts", lambda t, s, d: seen.append(len(s)) or count(t, s, d))
    assert np.array_equal(hashing.signed_counts(tokens, texts, 16), whole) and seen == [2, 1, 2]


def test_few_vectors_meet_the_pivots_at_once():
    batch = pa.record_batch([pa.array(range(2 * cells.DEAL_ROWS + 1))], ["n"])
    parts = list(cells._pieces(iter([batch])))
    assert max(p.num_rows for p in parts) == cells.DEAL_ROWS
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(batch.num_rows))


def test_references_and_links_are_read_in_slices(monkeypatch):
    """A batch of long texts is never held whole as Python strings."""
    monkeypatch.setattr(html, "SLICE_BYTES", 10)
    held = []
    monkeypatch.setattr(html, "runs", lambda texts, limit: (held.append(r[1]) or r for r in runs(texts, limit)))
    values = pa.array(["a &amp; b", None, "&eacute;t&eacute;", "plain", "", "&lt;" * 9])
    assert html.unescape.func(values).to_pylist() == ["a & b", None, "\u00e9t\u00e9", "plain", "", "<" * 9]
    base = pa.array(["https://a.example/x/"] * 6)
    links = html.resolve.func(base, pa.array(["y", None, "/z?q=1&r=2", "//b.example/", "http://[", "https://c.example/long"]))
    assert links.to_pylist() == [
        "https://a.example/x/y", "https://a.example/x/", "https://a.example/z?q=1&r=2", "https://b.example/", "http://[", "https://c.example/long"
    ]
    assert max(held) <= 3 and sum(held) == 12
    empty = pa.array([], pa.string())
    assert html.unescape.func(empty).to_pylist() == [] == html.resolve.func(empty, empty).to_pylist()

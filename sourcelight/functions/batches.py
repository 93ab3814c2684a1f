"""Cutting Arrow batches, whose rows are counted, by the size of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of neighbouring texts that hold at most ``limit`` bytes together, or of one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).cumsum(dtype=np.int64)
    low = 0
    while low < len(texts):
        used = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, used + limit, side="right")))
        yield low, high - low
        low = high

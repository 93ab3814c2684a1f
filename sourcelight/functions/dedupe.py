"""Order-dependent suppression of repeated facts, as an Arrow-batched UDF."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shortest comparable fact and the similarity limit.
MIN_FACT = 12
SAME_RATIO = 0.86
_NUMBER = re.compile(r"^\d+[.、]\s*")
_CLAUSE_END = re.compile(r"[，,；;。！？!?]")


def repeats(candidate: str, chosen: list[str]) -> bool:
    """Whether a number-stripped, space-free fact repeats one already chosen."""
    if len(candidate) < MIN_FACT:
        return False
    head = _CLAUSE_END.split(candidate, maxsplit=1)[0]
    return any(
        candidate in other
        or other in candidate
        or (len(head) >= MIN_FACT and head == _CLAUSE_END.split(other, maxsplit=1)[0])
        or SequenceMatcher(None, candidate, other).ratio() >= SAME_RATIO
        for other in chosen
    )


def select_distinct(facts: list[str], limit: int, exact: bool = False) -> list[int]:
    """Positions of the kept facts; ``limit`` 0 keeps all.

    ``exact`` also drops short facts that equal an earlier one.
    """
    kept: list[int] = []
    keys: list[str] = []
    for i, fact in enumerate(facts):
        key = _NUMBER.sub("", fact).replace(" ", "")
        if not (exact and key in keys) and not repeats(key, keys):
            kept.append(i)
            keys.append(key)
            if limit and len(kept) == limit:
                break
    return kept


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _positions(facts: pd.Series, limit: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if f is None else select_distinct(list(f), int(n), bool(e))
            for f, n, e in zip(facts, limit, exact)
        ],
        dtype=object,
    )


def distinct_fact_positions(facts: Column, limit: Column, exact: bool = False) -> Column:
    """Zero-based positions of facts that do not repeat an earlier one.

    The array belongs to one question's best document (bounded by top-k).
    """
    return _positions(facts, limit.cast("int"), F.lit(exact))


def pick(values: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(values, i))

"""Result comparison: equal multisets of rows, and orderedness."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import Any


def canonical(value: Any, digits: int = 9) -> Any:
    """Values that compare equal across engines: numbers by significant digits, lists by content."""
    if value is None or isinstance(value, (str, bool, bytes)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v, digits) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    number = float(value)
    if math.isnan(number):
        return "nan"
    return f"{number + 0.0:.{digits}g}" if number else "0"


def multiset(columns: Sequence[str], rows: Iterable[Sequence[Any]]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(a_columns: Sequence[str], a: Iterable[Sequence[Any]], b_columns: Sequence[str], b: Iterable[Sequence[Any]]) -> str:
    """Empty if both hold the same columns and rows, else what differs first."""
    if sorted(a_columns) != sorted(b_columns):
        return f"columns {sorted(a_columns)} and {sorted(b_columns)}"
    x, y = multiset(a_columns, a), multiset(b_columns, b)
    if x == y:
        return ""
    return f"{sum(x.values())} and {sum(y.values())} rows; only left {list((x - y).items())[:2]}, only right {list((y - x).items())[:2]}"


def is_sorted(rows: Sequence[Sequence[Any]], keys: Sequence[tuple[int, bool, bool]]) -> bool:
    """Whether rows follow the keys (column, descending, nulls first)."""

    def rank(row):
        out = []
        for column, descending, nulls_first in keys:
            v = row[column]
            out.append(((v is not None) if nulls_first else (v is None), _Reversed(v) if descending and v is not None else (v if v is not None else 0)))
        return out

    return all(not (rank(b) < rank(a)) for a, b in zip(rows, rows[1:], strict=False))


class _Reversed:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return self.v == other.v

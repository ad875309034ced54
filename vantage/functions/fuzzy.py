"""Approximate containment as an Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def least_edits(needle: str, hay: str, most: int) -> int:
    """Fewest edits between ``needle`` and any window of ``hay``, or -1 above ``most``: one row of the table at a time."""
    if not needle:
        return 0
    row = list(range(len(needle) + 1))
    best = row[-1]
    for ch in hay:
        last, row[0] = row[0], 0
        for i, n in enumerate(needle, 1):
            last, row[i] = row[i], min(last + (n != ch), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best if best <= most else -1


def within_edits(needle: str, hay: str) -> Column:
    """Edits of the needle to a window of the hay if they are at most ``min(4, length / 10)``, else -1; null for nulls."""

    @F.pandas_udf("int")
    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else 0 if x in y else least_edits(x, y, min(4, len(x) // 10)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return judge(F.col(needle), F.col(hay))

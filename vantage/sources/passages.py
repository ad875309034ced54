"""Cutting texts into passages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 600, 40
#: Texts whose passages are held at once.
AT_ONCE = 256


def cut(text: str, most: int = MOST, least: int = LEAST) -> list[str]:
    """Passages of at most ``most`` characters: by paragraph, then line, then sentence, then hard; short ones join the one before."""
    parts = [text]
    for pattern in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+"):
        parts = [q for p in parts for q in (re.split(pattern, p) if len(p) > most else [p])]
    parts = [p[i : i + most] for p in parts for i in range(0, max(len(p), 1), most)]
    out: list[str] = []
    for p in (p.strip() for p in parts):
        if not p:
            continue
        if out and len(p) < least and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def split_passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, ord, passage)`` of every text; null and blank texts have none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), AT_ONCE):  # passages of a few texts at a time, whatever the size of a batch
                pdf = batch.iloc[lo : lo + AT_ONCE]
                yield pd.DataFrame([(i, n, p) for i, t in zip(pdf["id"], pdf["text"], strict=True) if isinstance(t, str) for n, p in enumerate(cut(t))], columns=["id", "ord", "passage"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(split, f"id {kind}, ord int, passage string")


def decode_entities(c: Column) -> Column:
    """Character references, named and numeric, as their characters."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return decode(c)

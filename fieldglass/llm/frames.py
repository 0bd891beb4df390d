"""Helpers on DataFrames that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.runtime import settle, stored_bytes

#: a written table of at most so many bytes may be sent to every executor
SMALL_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def if_small(table: DataFrame) -> DataFrame:
    """A *written* table, marked for broadcast if its files are small; beyond that joins are shuffled."""
    return F.broadcast(table) if stored_bytes(table) <= SMALL_BYTES else table


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text (null counts as empty)."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of the table has, in any case, made from the stems."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


__all__ = ["SMALL_BYTES", "if_small", "lower_ascii", "same", "settle", "stored_bytes", "text_key", "unused"]

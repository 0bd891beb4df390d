"""Bitmaps of fixed size that tell most keys that can't be of use from the others; they may only let too many through."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK_BITS = 1 << 24


def key_marks(keys: DataFrame, key: str, bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap with the bits of the keys set, one for each key; bits / 32 numbers at most reach the driver."""
    bit = F.pmod(F.col(key), F.lit(bits))
    parts = keys.select(F.floor(bit / 32).alias("slot"), F.expr(f"shiftleft(1L, CAST(pmod(`{key}`, 32) AS INT))").alias("mask"))
    parts = parts.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[parts.column("slot").to_numpy()] = parts.column("mask").to_numpy().astype(np.uint32)
    return out


def is_marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    bit = keys % (len(marks) * 32)
    return (marks[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) > 0

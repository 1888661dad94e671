"""A bitmap of fixed size that says which hashes may be in a table: what it lets through is checked by a join or a count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (8 MB): the most that is broadcast, whatever the table holds.
BITS = 26


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of a long column. Tasks set bits, Spark merges the words, and at most 2^20 words reach the driver."""
    h = F.col(column)
    word = F.shiftright(h, 6).bitwiseAND((1 << BITS - 6) - 1).cast("int").alias("at")
    bit = F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")
    rows = hashes.where(h.isNotNull()).groupBy(word).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be in the table."""
    word = bits[(hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)]
    return (word >> (hashes & np.uint64(63))) & np.uint64(1) == 1

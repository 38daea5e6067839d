"""A set of hashes as a table of bits of fixed size, for filters ahead of a shuffle.

A member is always found; another hash is found with the share of set bits as
probability, so whatever passes the filter must be settled by an exact step.
The table has ``2 ** SLOT_BITS`` bits (16 MB) for every size of the data; as it
fills up it lets more through, and nothing else changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SLOT_BITS = 27


class Marks:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> W.U(64 - SLOT_BITS)
        return (self.bits[slot >> W.U(6)] >> (slot & W.U(63))) & W.U(1) == 1


def no_bits() -> np.ndarray:
    return np.zeros(1 << (SLOT_BITS - 6), W.U)


def marked(bits: np.ndarray, hashes: DataFrame) -> np.ndarray:
    """``bits`` with the hashes of ``hashes`` (h) set; the bits are gathered in Spark, and at most
    2 ** (SLOT_BITS - 6) rows reach the driver."""
    slot = F.shiftrightunsigned("h", 64 - SLOT_BITS)
    rows = hashes.select(F.shiftright(slot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    got = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = bits.copy()
    out[got.column("at").to_numpy()] |= got.column("bits").to_numpy().view(W.U)
    return out

"""A bit table over 64-bit hashes, of bounded size, that executors use to rule rows out before a join decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the table, as powers of two.
LEAST_BITS, MOST_BITS = 20, 28


class Sieve:
    """Lets all hashes it was made of pass, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8 - 1).bit_length())

    def passes(self, h: np.ndarray) -> np.ndarray:
        slot = h.view(np.uint64) >> self.shift
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve(hashes: DataFrame, column: str, rows: int) -> Sieve:
    """Of a column of longs in ``rows`` rows; only distinct places of bounded number come to the driver."""
    power = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, rows)).bit_length()))
    bits = np.zeros((1 << power) // 8, np.uint8)
    if rows:
        # a place is a byte and the bits set in it
        slot = F.shiftrightunsigned(column, 64 - power).cast("int")
        places = hashes.select(F.shiftright(slot, 3).alias("at"), F.pow(F.lit(2), slot.bitwiseAND(7)).cast("int").alias("bit"))
        found = places.groupBy("at").agg(F.bit_or("bit").cast("smallint").alias("bits")).toArrow()
        bits[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return Sieve(bits)

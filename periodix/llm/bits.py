"""A bit array of fixed size that keeps rows from a shuffle they cannot match.

It never decides a result: a key that was put in is always found, and what is
found by chance is dropped by the join that follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK_BITS = 1 << 23


class Bits:
    """A bit array of fixed size with two probes per key: a key that was put
    in is always found, others rarely."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys & np.uint64(MARK_BITS - 1), (keys >> np.uint64(32)) & np.uint64(MARK_BITS - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys.view(np.uint64))
        return self.bits[a] & self.bits[b]


def bit_array(keys: DataFrame, column: str) -> bytes:
    """The bits of all keys, put together on the executors word by word; the
    result has ``MARK_BITS / 8`` bytes however many keys there are."""
    key = F.col(column)
    words = (keys.select(F.explode(F.array(key.bitwiseAND(F.lit(MARK_BITS - 1)),
                                           F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(MARK_BITS - 1)))).alias("p"))
             .select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    out = np.zeros(MARK_BITS // 64, np.int64)
    got = words.toArrow()  # one row per word of the array at most
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.tobytes()

"""A filter of 64-bit keys: a bit for each key, built by the executors, small enough to be sent to all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and greatest number of bits; the greatest is 64 MB.
KEY_BITS, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 29


class KeyFilter:
    """A bit for each key of a frame, built by the executors and held as bytes; bits are sized by the number of keys."""

    def __init__(self, keys: DataFrame, n: int, key_bits: int = KEY_BITS, twice: bool = False) -> None:
        """keys: one column key, long; n: about how many; twice: two bits a key, for fewer false hits."""
        self.bits, self.twice = min(MOST_BITS, max(LEAST_BITS, 1 << (key_bits * max(n, 1) - 1).bit_length())), twice
        pos = F.pmod(F.col("key"), F.lit(self.bits)) + 1
        if twice:
            keys = keys.select(F.explode(F.array("key", F.shiftright("key", 31))).alias("key"))
        blocks = keys.groupBy(F.bitmap_bucket_number(pos).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bits"))
        self.map = np.zeros(self.bits >> 3, np.uint8)
        for r in blocks.toLocalIterator():  # bits / 8 bytes in all
            at = (r.block - 1) << 12
            part = np.frombuffer(r.bits, np.uint8)[: len(self.map) - at]
            self.map[at : at + len(part)] = part

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be among those given; all that are."""
        keys = keys.view(np.int64) if len(keys) else np.empty(0, np.int64)
        ok = self._at(keys % self.bits)
        if self.twice:
            ok &= self._at((keys >> 31) % self.bits)
        return ok

    def _at(self, pos: np.ndarray) -> np.ndarray:
        return (self.map[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 > 0

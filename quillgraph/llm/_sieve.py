"""A Bloom filter over the keys of a small table, to drop rows of a large one before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bits a key, and bits at most: 16 MB are broadcast whatever the input. Beyond about 13 million keys the filter fills up
#: and lets more rows through; the join after it decides, so results are the same.
BITS_A_KEY = 10
MOST_BITS = 1 << 27


def key_hash(key: Column) -> Column:
    """The 64 bits that ``Sieve.passes`` takes; both sides need the same type."""
    return F.xxhash64(key)


class Sieve:
    """Three of ``size`` bits for each key's hash; ``size`` is a power of two."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size

    @classmethod
    def over(cls, keys: DataFrame, hashed: Column) -> Sieve:
        """The filter of all rows of ``keys``; the driver gets ``size`` / 64 rows at most."""
        n = keys.count()
        size = min(MOST_BITS, 1 << max(10, (BITS_A_KEY * n).bit_length()))
        h = keys.select(hashed.alias("h"))
        places = F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(size - 1)) for s in (0, 18, 36)])
        bits = h.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        found = bits.agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
        words = np.zeros(size // 64, np.uint64)
        words[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return cls(words, size)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each signed 64-bit hash may be among the keys; never false for one that is."""
        h = hashes.view(np.uint64)
        out = np.ones(len(h), bool)
        for s in (0, 18, 36):
            p = (h >> np.uint64(s)) & np.uint64(self.size - 1)
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

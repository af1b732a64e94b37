"""A mergeable Bloom filter in plain columns.

Keys are hashed once to 64 bits; two positions come out of the two halves.
The filter is an array of 64-bit words: keys set bits with ``bit_or``, which
Spark merges before its shuffle, so two filters of the same size are one by
the same aggregate.  A test is two array lookups inside generated code, with
no join and no Python; a key that was put in always passes, so whatever is
filtered can be tested exactly afterwards.

The size follows the number of keys (``BITS_PER_KEY``) up to ``MAX_BITS``
(1 MB), whatever the data; beyond it more keys that were never put in pass,
and the exact test has more to do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
MIN_BITS, MAX_BITS = 1 << 12, 1 << 23


def _positions(cols, bits: int) -> list[Column]:
    h = F.xxhash64(*cols)
    return [F.pmod(h, F.lit(bits).cast("long")), F.pmod(F.shiftright(h, 27), F.lit(bits - 1).cast("long"))]


@dataclass
class BloomFilter:
    bits: int
    words: Column                    # array<bigint>, a scalar subquery

    @classmethod
    def of(cls, keys: DataFrame, *cols: str, count: int | None = None) -> "BloomFilter":
        """The filter of the given columns' values in ``keys``."""
        n = keys.count() if count is None else count
        bits = min(max(1 << max(n * BITS_PER_KEY - 1, 1).bit_length(), MIN_BITS), MAX_BITS)
        at = keys.select(F.explode(F.array(*_positions(cols, bits))).alias("p"))
        one = F.expr("shiftleft(1L, cast(p & 63 as int))")
        words = at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(one).alias("w"))
        empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
        words = words.unionByName(empty).groupBy("i").agg(F.bit_or("w").alias("w"))
        whole = words.agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("all"))       # bits / 64 words
        return cls(bits, whole.select(F.transform("all", lambda x: x["w"])).scalar())

    def may_hold(self, *cols) -> Column:
        """False only where the columns' values were not put in."""
        test = [F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
                for p in _positions(cols, self.bits)]
        return test[0] & test[1]

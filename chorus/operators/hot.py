"""Joins whose key may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions.bloom import BloomFilter

HOT_ROWS = 200_000               # rows of one key that are left in one task
MOST_SALTS = 1024
HOT_KEYS = 100_000               # keys, the most frequent ones, whose table rows are copied to every task
STEPS = 8                        # sizes told apart between two powers of two


def salted_join(rows: DataFrame, table: DataFrame, key: str, size: str, spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` of one row per key, whose
    column ``size`` says about how many rows the key has.  Where a key has
    more than ``hot_rows``, its rows are dealt over salts by a hash of
    ``spread`` and its table row is copied to each.  Both sides tell a hot
    key by the same Bloom filter, so a key that it passes by chance is dealt
    and copied too and the join stays exact.  ``table`` is read up to four
    times: store it."""
    most = table.agg(F.max(size)).first()[0] or 0
    if most <= hot_rows:
        return rows.join(table, key)
    salts = min(-(-int(most) // hot_rows), MOST_SALTS)
    hot = BloomFilter.of(table.filter(F.col(size) > hot_rows), key).may_hold(key)
    dealt = rows.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("_salt", F.explode(every)), [key, "_salt"]).drop("_salt")


def hot_size(table: DataFrame, size: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> int:
    """The least ``size`` of a hot key: so that about ``hot_keys`` keys at
    most are hot, and each key of more than ``hot_rows`` rows is.  Read off a
    histogram of the sizes' logarithms, a few hundred rows."""
    step = F.floor(F.log2(F.greatest(F.col(size), F.lit(1))) * STEPS)
    least, held = hot_rows + 1, 0
    for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(size).alias("least")).orderBy(F.col("step").desc()).collect():
        held += r.n
        if held > hot_keys:
            break
        least = min(least, r.least)
    return least


def frequent_join(rows: DataFrame, table: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` of one row per key, whose
    column ``size`` says about how many rows the key has.

    The most frequent keys hold nearly all rows: their part of the table, no
    larger for a larger table, is broadcast, and their rows stay where they
    are.  Of the others only rows of a rare key, told by a Bloom filter inside
    the row, meet the rest of the table in a shuffle; a key is in one of the
    two parts, so together they are the exact join.  ``rows`` and ``table``
    are read twice or more: store them."""
    least = hot_size(table, size, hot_rows, hot_keys)
    rare = table.filter(F.col(size) < least)
    hot = rows.join(F.broadcast(table.filter(F.col(size) >= least)), key)
    if rare.isEmpty():
        return hot
    return hot.unionByName(rows.filter(BloomFilter.of(rare, key).may_hold(key)).join(rare, key))

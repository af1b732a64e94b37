"""Cleaning, row filters and profiles (ops 6-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.functions.text import clean_light, clean_strict


def add_clean_comment(df: DataFrame, strict: bool = True, src: str = "comment",
                      out: str = "clean_comment") -> DataFrame:
    """Ops 6 / 7: strict (whitelist) or light cleaning of ``src``."""
    return df.withColumn(out, clean_strict(src) if strict else clean_light(src))


def drop_empty(df: DataFrame, col: str = "clean_comment") -> DataFrame:
    """Op 8: keep rows whose cleaned text is non-empty."""
    return df.filter(F.length(col) > 0)


def dedup_keep_first(df: DataFrame, col: str = "clean_comment",
                     order_col: str = "comment_id", drop_empty: bool = False) -> DataFrame:
    """Op 9: drop later rows with the same cleaned text (case-sensitive,
    across videos); the row with the lowest ``order_col`` wins.

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before
    the shuffle, so a text repeated in a third of all rows is cut to one row
    per map task before it moves.  Unlike ``dropDuplicates`` the kept row is
    deterministic.

    ``drop_empty=True`` also drops empty texts (op 8).  The test is written
    against the row number so Catalyst cannot push it below the cleaning
    projection, which would run the cleaning regexes twice per row.
    """
    # The 64-bit hash leads the key: the shuffle and the sort compare a long
    # prefix first and touch the full text only on a hash tie; the text stays
    # in the key, so equal hashes of different texts are never merged.
    w = Window.partitionBy(F.xxhash64(col), col).orderBy(F.col(order_col))
    rn = F.col("_rn")
    keep = rn <= 1
    if drop_empty:
        # ``rn <= 1`` (not ``rn = 1``): an equality would let constant
        # propagation rewrite the second test to ``length > 0`` alone and
        # push it below the window.
        keep = keep & (F.length(col) + rn > 1)
    return df.withColumn("_rn", F.row_number().over(w)).filter(keep).drop("_rn")


def prepare_comments(df: DataFrame, strict: bool = True, dedup: bool = True) -> DataFrame:
    """Op 10: clean -> drop empty -> de-duplicate (the notebooks skip the
    last two steps: ``dedup=False`` keeps every row)."""
    out = add_clean_comment(df, strict=strict)
    if dedup:
        out = dedup_keep_first(out, drop_empty=True)
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """Op 11: ``(column, nulls)`` -- one aggregate pass, then unpivot."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "nulls")


def preview(df: DataFrame, n: int = 20, order_col: str = "comment_id") -> DataFrame:
    """Op 12: first ``n`` rows in comment order (TakeOrderedAndProject)."""
    return df.orderBy(order_col).limit(n)

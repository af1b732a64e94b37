"""Array steps that take more than one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_term_counts(df: DataFrame, tokens: Column, out: str) -> DataFrame:
    """Add ``out``, ``array<struct<term, n>>``: each distinct token of the row
    once with its number, counted inside the row.

    The sorted array, then the places where a run begins, are columns of
    their own that the next step reads more than once, so Spark keeps them
    in separate projections and computes each once a row.
    """
    s, at = f"_{out}_sorted", f"_{out}_begins"
    n = F.size(s)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    counted = F.zip_with(F.col(at), F.concat(F.slice(at, 2, F.size(at)), F.array(n + 1)),
                         lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (b - a).cast("long").alias("n")))
    none = F.array().cast("array<struct<term:string,n:bigint>>")
    df = df.withColumn(s, F.sort_array(tokens))
    df = df.withColumn(at, F.when(n > 0, begins).otherwise(F.array().cast("array<int>")))
    return df.withColumn(out, F.when(F.size(at) > 0, counted).otherwise(none)).drop(s, at)


def exploded_counts(df: DataFrame, cols: list, tokens: Column) -> DataFrame:
    """``cols, term, n``: one row per distinct token of each row."""
    rows = with_term_counts(df, tokens, "_counts").select(*cols, F.explode_outer("_counts").alias("_c"))
    return rows.filter(F.col("_c").isNotNull()).select(*cols, F.col("_c.term").alias("term"), F.col("_c.n").alias("n"))

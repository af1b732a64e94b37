"""Stage tables: a plan consumed more than once is written once.

The table goes to a fresh folder under the shared ``spark.checkpoint.dir``
(never a machine-local temp folder), as parquet, so readers get column
pruning and the lineage is cut: a lost executor re-reads the stage instead
of recomputing cleaning and de-duplication.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from chorus.session import drop_scratch, free_shuffles, scratch_path

CODEC = "zstd"                   # of tables as large as the corpus: two thirds of the usual size


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_large(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for what grows with the corpus: packed closer, and the
    shuffles that made it go as soon as it is written.  ``unstage`` drops it
    when its last reader is done."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)
    free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stage_large`` in buckets of ``key``, a column that ``df`` is already
    dealt by: joins and sums by it leave the rows where they are."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"chorus_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", CODEC).bucketBy(buckets, key).saveAsTable(table)
    free_shuffles(spark)
    out = spark.table(table)
    out.staged_at, out.staged_as = path, table
    return out


def unstage(*tables: DataFrame) -> None:
    """Drop large stage tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "staged_as"):
            t.sparkSession.sql(f"DROP TABLE {t.staged_as}")
        drop_scratch(t.sparkSession, t.staged_at)

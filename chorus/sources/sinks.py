"""CSV sinks (ops 50-51).

Results are written with a header, UTF-8, ``"`` as quote and escape
(comments hold quotes, commas and newlines) and read back with
``multiLine``.  CSV has no array type, so list columns are written as JSON
text first.  As in a plain CSV export, an empty text and a null cannot be
told apart on read-back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = {"compression": "gzip"}
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def arrays_to_json(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", packed: bool = False) -> str:
    """Op 50: write ``df`` as CSV (header, no index); ``packed``: as
    ``.csv.gz``, which readers of CSV open as they do plain files."""
    writer(arrays_to_json(df), packed).mode(mode).csv(path)
    return path


def writer(df: DataFrame, packed: bool = False) -> DataFrameWriter:
    return df.write.options(**CSV_OPTIONS, **(PACKED if packed else {}))


def write_topics_csv(df: DataFrame, path: str, mode: str = "overwrite", packed: bool = False, rows: DataFrame | None = None) -> bool:
    """Op 51: topic results including list columns, only if there are any
    rows.  Returns whether anything was written.  ``rows``: a table that is
    empty if ``df`` is and cheaper to ask."""
    if (df if rows is None else rows).isEmpty():
        return False
    write_csv(df, path, mode, packed)
    return True


def flat_schema(schema: T.StructType) -> T.StructType:
    """The schema as CSV holds it: list columns as text, all nullable."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                      else f.dataType, True) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back a written result with its schema (list columns as text)."""
    return spark.read.options(**CSV_OPTIONS).option("multiLine", "true").schema(flat_schema(schema)).csv(path)

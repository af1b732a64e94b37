"""Results published as one (ops 50-51).

A result is written as a numbered version: part files in a folder of their
own, in the order of its key, then a manifest that names every part with its
length, the number of rows and the schema.  Readers go by the newest manifest
alone: until it is renamed into place they see the version before (or
nothing), afterwards the whole new one, and a job that fails or is lost
half-way leaves nothing readable.  Two writers at once publish two whole
versions; the later number wins, then the larger name.

Everything goes through Spark's writer and file systems, so any scheme that
Spark can write to will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.sources.files import Files
from chorus.sources.sinks import CSV_OPTIONS, arrays_to_json, flat_schema, writer

KEEP = 2                         # versions kept: the newest, and the one before for readers under way
PART_ROWS = 1_000_000            # a CSV with line breaks inside its texts is read a file a task


class NotPublished(RuntimeError):
    pass


def _manifests(files: Files, path: str) -> list[str]:
    return sorted(s.getPath().toString() for s in files.listing(path) if s.getPath().getName().startswith("manifest-"))


def _manifest(files: Files, path: str) -> dict:
    held = _manifests(files, path)
    if not held:
        raise NotPublished(path)
    return json.loads(files.read(held[-1]))


def ordered_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key``,
    in the order of ``key``: both are dealt together to ranges of it, so the
    rows move once for the join and the order; a table row is then handed to
    the rows of its key by a window."""
    cols = [c for c in table.columns if c != key]
    both = rows.withColumn("_held", F.lit(None).cast(table.select(F.struct(*cols).alias("_held")).schema[0].dataType)).withColumn("_row", F.lit(True))
    given = table.select(key, F.struct(*cols).alias("_held"), F.lit(False).alias("_row"))
    dealt = both.unionByName(given, allowMissingColumns=True).repartitionByRange(key)
    held = dealt.withColumn("_held", F.first("_held", ignorenulls=True).over(Window.partitionBy(key)))
    return held.filter(F.col("_row") & F.col("_held").isNotNull() & F.col(key).isNotNull()).select(*rows.columns, "_held.*")


def publish_csv(df: DataFrame, path: str, order: list[str], keep: int = KEEP, part_rows: int = PART_ROWS,
                ordered: bool = False, packed: bool = False) -> dict:
    """Write ``df`` as CSV parts ordered by ``order`` and publish them as one
    version; returns its manifest.

    Parts are ranges of ``order`` (sampled bounds, no total sort), sorted
    inside, and named in that order.  Rows with equal keys land in one range,
    so ``order`` should end with a unique column; a range of any size is cut
    into files of ``part_rows`` rows.  List columns are written as JSON text.
    ``ordered``: the rows of ``df`` lie in such ranges already, as those of
    ``ordered_join`` do; ``packed``: parts are ``.csv.gz``.
    If the write fails its folder is dropped, the error goes on to the
    caller and the version before stays the readable one.
    """
    spark = df.sparkSession
    files = Files(spark, path)
    files.make(path)
    name = uuid.uuid4().hex[:12]
    folder = f"{path.rstrip('/')}/parts-{name}"
    seen = Observation(f"published-{name}")
    rows = arrays_to_json(df)
    rows = (rows if ordered else rows.repartitionByRange(*order)).sortWithinPartitions(*order).observe(seen, F.count(F.lit(1)).alias("rows"))
    try:
        writer(rows, packed).option("maxRecordsPerFile", str(part_rows)).csv(folder)
        parts = sorted((p.rsplit("/", 1)[-1], length) for p, length, _ in files.files(folder) if p.endswith((".csv", ".csv.gz")))
        held = _manifests(files, path)
        number = 1 + (int(held[-1].rsplit("/", 1)[-1].split("-")[1]) if held else 0)
        manifest = {"version": number, "folder": f"parts-{name}", "parts": [list(p) for p in parts],
                    "rows": seen.get["rows"], "order": order, "schema": flat_schema(df.schema).jsonValue()}
        draft = f"{path.rstrip('/')}/.{name}"
        files.write(draft, json.dumps(manifest))
        if not files.rename(draft, f"{path.rstrip('/')}/manifest-{number:010d}-{name}"):
            raise NotPublished(f"{path}: the manifest could not be put into place")
    except BaseException:
        files.drop(folder)
        raise
    for old in _manifests(files, path)[:-keep]:
        gone = json.loads(files.read(old))["folder"]
        files.drop(old)                     # first the name, then what it names
        files.drop(f"{path.rstrip('/')}/{gone}")
    return manifest


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest version, read by its manifest; a part that is missing or
    has another length raises ``NotPublished``, so no result is read in part."""
    files = Files(spark, path)
    m = _manifest(files, path)
    folder = f"{path.rstrip('/')}/{m['folder']}"
    there = {p.rsplit("/", 1)[-1]: length for p, length, _ in files.files(folder)}
    bad = [p for p, length in m["parts"] if there.get(p) != length]
    if bad:
        raise NotPublished(f"{folder}: {bad[:3]} missing or changed")
    schema = T.StructType.fromJson(m["schema"])
    if not m["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.options(**CSV_OPTIONS).option("multiLine", "true").schema(schema).csv([f"{folder}/{p}" for p, _ in m["parts"]])


def published_rows(spark: SparkSession, path: str) -> int:
    """Rows of the newest version, from its manifest alone."""
    return _manifest(Files(spark, path), path)["rows"]

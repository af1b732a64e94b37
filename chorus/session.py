"""Session helpers.

Library code never creates its own session: every operator takes the
DataFrames it is given.  ``get_session`` is for tests, the bench and the
command line only.  Cluster settings (``spark.checkpoint.dir`` above all) are
read from the session; a local default is filled in only when unset.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast decision: a join side is broadcast only when its
    # measured (post-shuffle) size is under this bound; otherwise AQE keeps
    # the sort-merge join.  This is the size check for every data-derived
    # table (vocabularies, model weights).
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "chorus") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CHORUS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) a folder under the system temp dir is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or None
    if d is None:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        d = tempfile.mkdtemp(prefix="chorus-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_CREATED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local
    temp folder on a cluster).  Used for stage tables, model files and sink
    read-backs.  The path is recorded so ``release_scratch`` can drop it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/chorus-{name}-{uuid.uuid4().hex[:12]}"
    _CREATED.append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one folder that ``scratch_path`` named."""
    if path in _CREATED:
        _CREATED.remove(path)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of queries that have ended: its
    cleaner does so once the driver has collected their plans as garbage,
    which left alone may be half an hour later."""
    spark.sparkContext._jvm.System.gc()


def scratch_mark() -> int:
    return len(_CREATED)


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the folders this process created (from mark ``since`` on)
    through the Hadoop FileSystem API.  Only recorded paths are touched;
    call it once their DataFrames are no longer read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while len(_CREATED) > since:
        path = _CREATED.pop()
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            done += 1
    return done

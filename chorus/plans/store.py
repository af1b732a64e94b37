"""Stored tables that several queries of a session, or several sessions, read.

A table is named by what it is computed from: its name, its parameters and a
fingerprint of its input files (path, length, time of change), so a changed
input or parameter never meets an old table.  It is written to a folder of
its own under the shared ``spark.checkpoint.dir`` and then published by
renaming a small pointer file into place: a reader sees a whole table or
none, and a writer that is lost half-way leaves nothing readable.  If two
writers build the same table at once, either pointer names a whole one.

Every use renews a pointer's time; ``expire`` drops tables that were not used
for ``spark.chorus.store.ttlSeconds`` (a week unless set), together with
folders that no pointer names.  It runs when a table is published.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chorus.plans.stage import CODEC
from chorus.session import ensure_checkpoint_dir, free_shuffles
from chorus.sources.files import Files

VERSION = 2
TTL_SECONDS = 7 * 24 * 3600
WRITES: Counter = Counter()          # tables written by this process, by name


def fingerprint(spark: SparkSession, sources: list[str]) -> str:
    h = hashlib.sha256()
    for source in sources:
        for row in sorted(Files(spark, source).files(source)):
            h.update(repr(row).encode())
    return h.hexdigest()


def _root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/chorus-store"


def stored(spark: SparkSession, name: str, sources: list[str], params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of these sources and parameters: read if it is
    published, else built, written once and published."""
    key = hashlib.sha256(json.dumps([VERSION, name, params, fingerprint(spark, sources)], sort_keys=True, default=str).encode()).hexdigest()[:24]
    root = _root(spark)
    files = Files(spark, root)
    pointer = f"{root}/{name}-{key}.json"
    held = files.read(pointer)
    if held is None:
        table = f"{root}/{name}-{key}-{uuid.uuid4().hex[:8]}"
        build().write.option("compression", CODEC).parquet(table)
        free_shuffles(spark)
        WRITES[name] += 1
        held = json.dumps({"table": table})
        draft = f"{root}/.{uuid.uuid4().hex}"
        files.write(draft, held)
        if not files.fs.rename(files.path(draft), files.path(pointer)):        # another writer was first: its table is whole
            files.fs.delete(files.path(draft), False)
            held = files.read(pointer) or held
        expire(spark)
    else:
        files.fs.setTimes(files.path(pointer), int(time.time() * 1000), -1)
    return spark.read.parquet(json.loads(held)["table"])


def expire(spark: SparkSession, ttl_seconds: float | None = None) -> int:
    """Drop tables not used for so long; the number of folders dropped."""
    if ttl_seconds is None:
        ttl_seconds = float(spark.conf.get("spark.chorus.store.ttlSeconds", str(TTL_SECONDS)))
    root, before = _root(spark), (time.time() - ttl_seconds) * 1000
    files, named, dropped = Files(spark, root), set(), 0
    listing = files.listing(root)
    for s in listing:
        if s.isDirectory():
            continue
        p = s.getPath().toString()
        if s.getModificationTime() <= before:
            files.fs.delete(s.getPath(), False)
        elif p.endswith(".json"):
            named.add(json.loads(files.read(p))["table"].rsplit("/", 1)[-1])
    for s in listing:
        if s.isDirectory() and s.getPath().getName() not in named and s.getModificationTime() <= before:
            files.fs.delete(s.getPath(), True)
            dropped += 1
    return dropped


def clear(spark: SparkSession) -> None:
    """Drop the whole store; no table of it may be in use."""
    files = Files(spark, _root(spark))
    files.fs.delete(files.path(_root(spark)), True)

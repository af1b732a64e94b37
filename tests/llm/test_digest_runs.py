"""Merging of sorted digest runs against a plain grouping."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from chorus.llm import exact_dedup as E


def table(rows):
    cols = list(zip(*rows))
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["digest", "n_bytes", "best_id", "best_row", "group_size", "home"])


def plain(rows, largest):
    groups = collections.defaultdict(list)
    for d, n, i, r, c, _ in rows:
        groups[d, n].append((i, r, c))
    out = []
    for (d, n), g in sorted(groups.items()):
        ids = [i for i, _, _ in g if i is not None]
        best = (max(ids) if largest else min(ids)) if ids else None
        out.append((d, n, best, max(r for i, r, _ in g if i == best), sum(c for _, _, c in g)))
    return out


@pytest.mark.parametrize("largest", [True, False])
def test_slices_are_merged(largest):
    rng = random.Random(6)
    names = [hashlib.sha256(str(i).encode()).digest() for i in range(40)] + [b"\0" * 32, b"a" + b"\0" * 31]
    lowest = np.iinfo(np.int64).min
    slices = []
    for s in range(9):
        rows = []
        for k in sorted(rng.sample(range(len(names)), rng.randint(0, 30)), key=lambda k: (names[k], k % 3 * 256)):
            rows.append((names[k], k % 3 * 256, rng.choice([None, 5, 7, -3, lowest + 1, 2**62]), rng.randrange(1000) * 10 + s, rng.randint(1, 4), 0))
        slices.append(rows)
    rows = [r for s in slices for r in s]
    got = pa.Table.from_batches(list(E.merge_runs(largest)([table(s) for s in slices if s]))).drop_columns(["home"]).to_pylist()
    assert [tuple(r.values()) for r in got] == plain(rows, largest)
    assert len(E.Entries.read(pa.Table.from_batches([table(rows)])).runs()) <= sum(bool(s) for s in slices)
    mixed = rows[:]
    rng.shuffle(mixed)
    got = pa.Table.from_batches(list(E.merge_runs(largest, sort=True)([table(mixed)]))).drop_columns(["home"]).to_pylist()
    assert [tuple(r.values()) for r in got] == plain(rows, largest)
    assert list(E.merge_runs(largest)([])) == []


def test_rounds_receive_sorted_slices(spark, sf):
    """After an exchange a task's rows are a few sorted slices, one a sender,
    not rows in any order."""
    rows = E.digests(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(16))
    run = rows.select("digest", "n_bytes", E.F.col("doc_id").alias("best_id"), E.F.col("row_no").alias("best_row"),
                      E.F.lit(1).cast("bigint").alias("group_size"), E.F.lit(0).alias("home")).mapInArrow(E.merge_runs(True, sort=True), E.RUN)

    def slices(batches):
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        if t.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(E.Entries.read(t).runs())]), pa.array([t.num_rows])], names=["runs", "rows"])

    to = E.F.conv(E.F.substring(E.F.hex("digest"), 1, 4), 16, 10).cast("int") % 4
    got = run.withColumn("to", to).repartitionById(4, E.F.col("to")).drop("to").mapInArrow(slices, "runs bigint, rows bigint").collect()
    assert len(got) == 4 and all(r.runs <= 16 and r.rows > 1000 for r in got)

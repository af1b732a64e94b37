"""Exact de-duplication by a tree-merge of sorted digest runs.

Every document gives a digest (SHA-256 of its text, its length, its id).
Each of ``P`` partitions sorts its digests into a run and merges equal ones
into one entry: digest, identifier that stays, number of rows.  The runs are
then exchanged in ``log_F(P)`` rounds of a binomial tree of fan-in ``F``: in
round ``r`` the partitions whose numbers differ only in digit ``r`` trade
slices so that each keeps the digests whose own digit ``r`` is its number's,
and merges the sorted slices that it receives, told apart where keys fall,
without sorting again.  Equal digests are
merged at every level, so a group of copies, however large, is one entry a
partition from the first run on; after the last round each partition holds
a share of the digests of its own and no partition ever holds them all.

An entry is merged with another only if the whole digest and the text's
length agree (``verified``).  The identifier kept is the largest or the
smallest ``doc_id``; rows that repeat text and id are told apart by a row
number, so one of them stays.

Cases: null text counts as empty; null ``doc_id`` is below all others and
stays only if the group has no other; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import full_text, table
from chorus.plans.stage import stage

FAN_IN = 8
ROWS_PER_PARTITION = 200_000
BROADCAST_ROWS = 300_000        # rows of some fifty bytes that may be broadcast
RUN = "digest binary, n_bytes bigint, best_id bigint, best_row bigint, group_size bigint, home int"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, n_bytes, row_no`` of every document."""
    t = full_text(text)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"),
                       F.octet_length(t).cast("bigint").alias("n_bytes"),
                       F.monotonically_increasing_id().alias("row_no"))


class Entries:
    """Entries in the order of their keys, digest and length; columns by name."""

    def __init__(self, key: np.ndarray, **cols: np.ndarray):
        self.key, self.cols = key, cols

    @classmethod
    def read(cls, t: pa.Table) -> "Entries":
        raw = np.frombuffer(b"".join(t["digest"].to_pylist()), dtype=np.uint8).reshape(-1, 32)
        size = t["n_bytes"].to_numpy().astype(">u8")
        key = np.ascontiguousarray(np.concatenate([raw, size.view(np.uint8).reshape(-1, 8)], axis=1)).view("S40").ravel()
        none = t["best_id"].is_null().to_numpy()
        return cls(key, id=t["best_id"].fill_null(0).to_numpy(), none=none, row=t["best_row"].to_numpy(),
                   count=t["group_size"].to_numpy(), home=t["home"].to_numpy())

    def take(self, at) -> "Entries":
        return Entries(self.key[at], **{n: c[at] for n, c in self.cols.items()})

    def runs(self) -> list["Entries"]:
        """The sorted slices that the rows are made of, cut where keys fall."""
        cuts = np.flatnonzero(self.key[1:] < self.key[:-1]) + 1
        return [self.take(slice(a, b)) for a, b in zip([0, *cuts], [*cuts, len(self.key)])]

    def batch(self) -> pa.RecordBatch:
        raw = self.key.view(np.uint8).reshape(-1, 40)
        size = np.ascontiguousarray(raw[:, 32:]).view(">u8").ravel().astype(np.int64)
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw[:, :32]).tobytes())])
        c = self.cols
        return pa.RecordBatch.from_arrays(
            [digest.cast(pa.binary()), pa.array(size), pa.array(c["id"], pa.int64(), mask=c["none"]), pa.array(c["row"]), pa.array(c["count"]),
             pa.array(c["home"], pa.int32())], names=["digest", "n_bytes", "best_id", "best_row", "group_size", "home"])


def merge_two(a: Entries, b: Entries) -> Entries:
    """Two sorted slices as one: each entry's place is its own number and
    that of the other slice's entries before it."""
    key = np.empty(len(a.key) + len(b.key), dtype=a.key.dtype)
    to_a = np.arange(len(a.key)) + np.searchsorted(b.key, a.key, side="left")
    to_b = np.arange(len(b.key)) + np.searchsorted(a.key, b.key, side="right")
    key[to_a], key[to_b] = a.key, b.key
    cols = {}
    for n in a.cols:
        cols[n] = np.empty(len(key), dtype=a.cols[n].dtype)
        cols[n][to_a], cols[n][to_b] = a.cols[n], b.cols[n]
    return Entries(key, **cols)


def one_a_group(e: Entries, largest: bool) -> Entries:
    """Equal neighbours as one entry: the best identifier, of its rows the
    last, and the sum of rows; a null identifier is worse than any other."""
    new = np.ones(len(e.key), dtype=bool)
    new[1:] = e.key[1:] != e.key[:-1]
    at = np.flatnonzero(new)
    if len(at) == len(e.key):
        return e
    group = np.cumsum(new) - 1
    c, low = e.cols, np.iinfo(np.int64).min
    value = c["id"] if largest else ~c["id"]                 # ~x falls as x rises, without overflow
    some = np.logical_or.reduceat(~c["none"], at)[group] & c["none"]
    value = np.where(some, low, value)
    best = (value == np.maximum.reduceat(value, at)[group]) & ~some
    row = np.maximum.reduceat(np.where(best, c["row"], low), at)
    keep = np.flatnonzero(best & (c["row"] == row[group]))
    keep = keep[np.unique(group[keep], return_index=True)[1]]
    out = e.take(keep)
    out.cols["count"] = np.add.reduceat(c["count"], at)
    return out


def merge_runs(largest: bool, sort: bool = False):
    """A task's rows as one run.  ``sort``: rows in any order are sorted into
    the first run; otherwise they are sorted slices, which are merged two by
    two, equal entries at every step."""

    def merge(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        e = Entries.read(pa.Table.from_batches(batches).combine_chunks())
        runs = [one_a_group(r, largest) for r in ([e.take(np.argsort(e.key, kind="stable"))] if sort else e.runs())]
        while len(runs) > 1:
            pairs = [one_a_group(merge_two(a, b), largest) for a, b in zip(runs[::2], runs[1::2])]
            runs = pairs + runs[len(pairs) * 2:]
        yield runs[0].batch()

    return merge


def merged_groups(rows: DataFrame, keep: str = "largest", partitions: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct digest of ``digests()``: ``digest, n_bytes,
    best_id, best_row, group_size``."""
    if partitions is None:
        spark = rows.sparkSession
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_PARTITION)
    rounds = max(1, math.ceil(math.log(max(partitions, 2), fan_in) - 1e-9))
    width = fan_in ** rounds if partitions > 1 else 1
    largest = keep == "largest"
    value = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint")      # home: uniform in the digest
    run = rows.select("digest", "n_bytes", F.col("doc_id").alias("best_id"), F.col("row_no").alias("best_row"),
                      F.lit(1).cast("bigint").alias("group_size"), (value % F.lit(partitions)).cast("int").alias("home"))
    run = run.mapInArrow(merge_runs(largest, sort=True), RUN)
    if partitions == 1:
        return run.repartitionById(1, F.lit(0)).mapInArrow(merge_runs(largest), RUN).drop("home")
    for r in range(rounds):
        # partition number after the round: the digits up to r are those of
        # the entry's home, the others are those of the partition it is in
        low = F.lit(fan_in ** (r + 1))
        here = F.spark_partition_id() % F.lit(width)
        to = (F.col("home") % low + here - here % low) if r < rounds - 1 else F.col("home")
        run = run.withColumn("to", (to % F.lit(partitions)).cast("int")).repartitionById(partitions, F.col("to")).drop("to")
        run = run.mapInArrow(merge_runs(largest), RUN)
    return run.drop("home")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
                partitions: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept,
    text_sha256, row_no``.  The digests are written once and read by both
    the merge and the join that hands its outcome back."""
    rows = stage(digests(docs, doc_id, text), "digests")
    groups = merged_groups(rows, keep, partitions)
    out = rows.join(groups, ["digest", "n_bytes"])
    return out.select("doc_id", F.col("best_id").alias("keep_id"), "group_size",
                      (F.col("row_no") == F.col("best_row")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "row_no")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The documents, of equal texts only the row that stays.  The rows to
    drop are few as a rule: their list is broadcast if it is short."""
    rows = stage(digests(docs, doc_id, text), "digests")
    groups = merged_groups(rows, keep)
    judged = rows.join(groups, ["digest", "n_bytes"]).filter("group_size > 1")
    same = judged.groupBy(F.col("doc_id").alias("_drop_id"), F.col("digest").alias("_drop_digest")).agg(
        (~F.max(F.col("row_no") == F.col("best_row"))).alias("_gone"), F.count("*").alias("_times"))
    same = stage(same.filter("_gone or _times > 1"), "drop")
    few = same.count() <= BROADCAST_ROWS
    digest = F.unhex(F.sha2(full_text(text).cast("binary"), 256))
    match = F.col(doc_id).eqNullSafe(F.col("_drop_id")) & (digest == F.col("_drop_digest"))
    out = docs.join(F.broadcast(same) if few else same, match, "left").filter("_gone is null or not _gone")
    once = out.filter("_times is null or _times = 1")
    if not same.filter("not _gone").isEmpty():           # rows that repeat both id and text: one of them
        again = out.filter("_times > 1").dropDuplicates(["_drop_id", "_drop_digest"])
        once = once.unionByName(again)
    return once.select(*[once[c] for c in docs.columns])


def op9_exact_dedup(spark, sf_dir):
    return deduplicate(table(spark, sf_dir, "documents")).drop("row_no")


OP9_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

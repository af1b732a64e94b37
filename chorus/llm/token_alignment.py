"""Alignment of two tokenisations of the same texts.

Both tokenizers encode a text, and every token gets its byte range.  In a
batch of documents ``pandas.merge_asof``, keyed by document, finds for each
token's start the token of the other side that covers it; the union of the
two directions holds every pair of tokens that overlap.  Pairs that end at
the same byte are the links, and their ends cut both sides into groups, the
smallest runs of tokens that cover the same bytes.

How often a pair of ids is linked is counted over all documents, and each
document is then judged by those counts.  A document hands over its distinct
pairs with their numbers, not its links; the table of counts, which holds at
most one row for two ids that ever met, is broadcast if it has no more than
``BROADCAST_PAIRS`` rows (24 bytes each), otherwise the documents' pairs are
joined to it by shuffle and summed by row.  Both ways give the same rows.

Cases: null and empty texts, and texts that one of the tokenizers does not
give back byte by byte, have no tokens: zeros and an empty hash; repeated
rows are aligned each and all count; null ids stay null; extra columns are
not read; an empty table gives an empty result; a very long text is a batch
of its own.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import slices_by_size, small_batches, table, utf8_buffers, worker_state
from chorus.llm.packing import TextEncoder
from chorus.plans.stage import stage

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
BATCH_BYTES = 250_000
BROADCAST_PAIRS = 2_000_000      # rows of 24 bytes: 48 MB
SHIFT = 32                       # a pair of ids is left << SHIFT | right

ALIGNED = ("doc_id bigint, row_no bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "pairs array<bigint>, times array<int>")


def library_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# ------------------------------------------------------------------ the two sides

class ByteSide:
    """A byte-level BPE file over space + text; special strings are text."""

    def __init__(self, path: str):
        coder = TextEncoder(path).coder
        self.encode_text = coder.encode_ordinary
        plain = [coder.decode_single_token_bytes(i) if i not in coder._special_tokens.values() else b"" for i in range(coder.n_vocab)]
        self.bytes_of = plain

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_text(" " + t) for t in texts]


class PieceSide:
    """A SentencePiece file, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.run = sp.encode
        self.bytes_of = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()
                         for i in range(sp.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.run(texts, num_threads=1)


class Side:
    """Ids with byte ranges, and the strings that name them in groups."""

    def __init__(self, coder, inner: str, outer: str):
        self.coder = coder
        self.length = np.array([len(b) for b in coder.bytes_of], dtype=np.int64)
        n = len(coder.bytes_of)
        self.names = [f"{i}{inner}" for i in range(n)] + [f"{i}{outer}" for i in range(n)]

    def gives_back(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.coder.bytes_of.__getitem__, ids)) == raw


class Aligner:
    def __init__(self, left: str, right: str):
        self.a, self.b = Side(ByteSide(left), ",", "|"), Side(PieceSide(right), ",", ";")
        self.names = self.a.names + self.b.names

    def batch(self, texts: list[str]):
        """``n_a, n_b, n_groups, hash, pairs, times`` of each text."""
        encoded = [side.coder.encode(texts) for side in (self.a, self.b)]
        raw = [b" " + t.encode() for t in texts]
        ok = [bool(t) and self.a.gives_back(x, r) and self.b.gives_back(y, r) for t, r, x, y in zip(texts, raw, *encoded)]
        frames = []
        for side, lists in zip((self.a, self.b), encoded):
            lists = [x if good else [] for x, good in zip(lists, ok)]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            ids = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum()))
            # both sides cover the same bytes, so places may run on through the batch and are sorted
            ends = np.cumsum(side.length[ids])
            frames.append((ids, sizes, pd.DataFrame({"doc": np.repeat(np.arange(len(texts), dtype=np.int32), sizes),
                                                     "start": ends - side.length[ids], "end": ends, "nth": np.arange(len(ids))})))
        return self._group(*frames[0], *frames[1])

    @staticmethod
    def _links(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that end together, in order: of the pairs that overlap, which
        are those of a token's start and the other side's token over it, in
        either direction, those with equal ends."""
        pairs = []
        for one, other, first in ((a, b, "nth_a"), (b, a, "nth_b")):
            names = ("_a", "_b") if first == "nth_a" else ("_b", "_a")
            over = pd.merge_asof(one, other, on="start", by="doc", suffixes=names)
            even = over["end_a"].to_numpy() == over["end_b"].to_numpy()
            pairs.append((over["nth_a"].to_numpy()[even], over["nth_b"].to_numpy()[even]))
        left, at = np.unique(np.concatenate([p[0] for p in pairs]), return_index=True)         # a token has one partner at most
        return left, np.concatenate([p[1] for p in pairs])[at]

    def _group(self, ids_a, sizes_a, a, ids_b, sizes_b, b):
        last_a, last_b = self._links(a, b) if len(a) else (ids_a, ids_b)          # a group ends at each link
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # the names in order: A tokens of a group, then its B tokens
        names, n_a, n_b = self.names, len(self.a.length), len(self.b.length)
        group_at = np.cumsum(size_a + size_b) - size_a - size_b
        place = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        name = ids_a.copy()
        name[last_a] += n_a
        place[np.arange(len(ids_a)) + np.repeat(group_at - (last_a + 1 - size_a), size_a)] = name
        name = ids_b + 2 * n_a
        name[last_b] += n_b
        place[np.arange(len(ids_b)) + np.repeat(group_at + size_a - (last_b + 1 - size_b), size_b)] = name
        pair = (ids_a[last_a] << SHIFT) | ids_b[last_b]
        at = np.concatenate(([0], np.cumsum(sizes_a + sizes_b)))
        per = np.searchsorted(last_a, np.concatenate(([0], np.cumsum(sizes_a))))
        out = []
        for i in range(len(sizes_a)):
            text = "".join([names[x] for x in place[at[i]:at[i + 1]].tolist()])
            pairs, times = np.unique(pair[per[i]:per[i + 1]], return_counts=True)
            sha = hashlib.sha256(text[:-1].encode()).hexdigest() if text else ""
            out.append((int(sizes_a[i]), int(sizes_b[i]), int(per[i + 1] - per[i]), sha, pairs, times))
        return out


def align_batches(left: str, right: str):
    """Aligns the documents of a task; see ``ALIGNED``."""

    def run(batches):
        aligner = worker_state(f"aligner:{left}:{right}", lambda: Aligner(left, right))
        for batch in batches:
            column = batch.column("text")
            _, offsets = utf8_buffers(column)
            for s, e in slices_by_size(offsets, BATCH_BYTES):
                got = aligner.batch([t or "" for t in column.slice(s, e - s).to_pylist()])
                n_a, n_b, groups, sha, pairs, times = zip(*got)
                bounds = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s, e - s), batch.column("row_no").slice(s, e - s), pa.array(n_a, pa.int64()),
                     pa.array(n_b, pa.int64()), pa.array(groups, pa.int64()), pa.array(groups, pa.int64()), pa.array(sha, pa.string()),
                     pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(pairs))),
                     pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(times).astype(np.int32)))],
                    names=["doc_id", "row_no", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


# ------------------------------------------------------------------ counts over the corpus

def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each pair of ids over all documents,
    and whether no pair with the same right-hand id has more."""
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = stage(rows.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    right = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(right.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, right == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def judge_in_row(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``n_best, count_sum`` from a broadcast table of counts."""
    t = counts.orderBy("pair").toPandas()                # at most BROADCAST_PAIRS rows, checked by the caller
    known = aligned.sparkSession.sparkContext.broadcast((t["pair"].to_numpy(np.int64), t["count"].to_numpy(np.int64), t["best"].to_numpy(bool)))

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def judge(pairs: pa.Array, times: pa.Array) -> pa.Array:
        names, count, best = known.value
        bounds = pairs.offsets.to_numpy().astype(np.int64)
        at = np.searchsorted(names, pairs.flatten().to_numpy())
        n = times.flatten().to_numpy().astype(np.int64)
        total = [np.concatenate(([0], np.cumsum(x))) for x in (n * best[at], n * count[at])]
        bounds = bounds - bounds[0]
        return pa.StructArray.from_arrays([pa.array(x[bounds[1:]] - x[bounds[:-1]]) for x in total], names=["n_best", "count_sum"])

    return aligned.withColumn("j", judge("pairs", "times")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "j.n_best", "j.count_sum", "groups_sha256")


def judge_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from a join of the documents' pairs with the counts."""
    rows = aligned.select("row_no", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row_no", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    sums = rows.join(counts, "pair").groupBy("row_no").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.join(sums, "row_no", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", left: str | None = None, right: str | None = None) -> DataFrame:
    """``doc_id, row_no, n_a, n_b, n_groups, n_links, groups_sha256, pairs,
    times`` of every document, written once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(align_batches(left or library_path(LEFT), right or library_path(RIGHT)), ALIGNED), "aligned")


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", left: str | None = None, right: str | None = None,
              broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``."""
    aligned = align(docs, doc_id, text, left, right)
    counts = stage(pair_counts(aligned), "pair-best")
    few = counts.count() <= broadcast_pairs
    return judge_in_row(aligned, counts) if few else judge_by_join(aligned, counts)


def op13_token_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))

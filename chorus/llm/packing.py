"""Packing of tokenised documents into fixed windows by non-negative least
squares.

Documents are tokenised and cut into full windows and one remainder.  The
histogram of piece lengths (at most ``window`` numbers, whatever the input)
goes to the driver, where shallow combinations of lengths that fill a window
exactly are enumerated: one length repeated and its complement, pairs, and
triples on a grid.  Repeat counts ``x >= 0`` that minimise ``|A x - h|`` are
solved for (multiplicative updates), rounded down and committed as far as
the histogram lasts; what is left is packed greedily, longest first, where
that fills a window nearly full.  The rest is laid end to end and cut at
window borders; its last, partial window is cut into sequences of powers of
two, which need no padding.

A plan is a list of intervals: "of the pieces of length ``l``, those ranked
``a`` to ``b`` are entry ``k`` of this combination".  Ranks are dealt out in
Spark by (length, salt) with as many salts as a length needs, so no length,
however common, meets in one task.  Only documents cut at a border are
tokenised once more, for the identifiers of their parts.

Cases: null text is empty and gives one piece, the end token; repeated rows
are packed each; null ids stay null; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import full_text, small_batches, table, worker_state
from chorus.plans.stage import stage

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
RANK_GROUP = 500                # pieces of one length ranked together
TRIPLE_GRID = 16
NNLS_STEPS = 200
GREEDY_WASTE = 8                # tokens a greedily packed window may leave empty
BROADCAST_ROWS = 100_000        # cut documents (some 40 bytes each) that may be broadcast


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# ------------------------------------------------------------------ tokens

class TextEncoder:
    """Ids of whole texts.  The vocabulary is read from the ``tokenizers``
    file; texts are encoded by ``tiktoken`` with that vocabulary as ranks,
    which gives the same ids in less time.  A text that holds an added token
    literally gets that token's id there, as the library gives it."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level alphabet: printable bytes stand for themselves, the
        # others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None, end: bytes) -> bytes:
        """Little-endian 32-bit ids of the text, the end id included."""
        return self.coder.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes() + end


def encoder(path: str) -> TextEncoder:
    return worker_state(f"encoder:{path}", lambda: TextEncoder(path))


PIECES = ("doc_id bigint, text_hash bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def cut_documents(path: str, window: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            rows, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts):
                raw = coder.encode(text, end)
                n, view = len(raw) // 4, memoryview(raw)
                for s in range(0, n, window):
                    rows.append(i)
                    start.append(s)
                    length.append(min(window, n - s))
                    crc.append(zlib.crc32(view[4 * s:4 * (s + window)]))
                    total.append(n)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), hashes.take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = full_text(text)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))


# ------------------------------------------------------------------ the plan

def combinations(present: np.ndarray, window: int, grid: int = TRIPLE_GRID) -> np.ndarray:
    """Shallow combinations that fill the window: rows ``(length, times) x
    3``, zero where unused; all lengths are present."""
    has = np.zeros(window + 1, dtype=bool)
    has[present] = True
    one = present[present < window]
    rows = []

    def add(a, ka, b, kb, c, kc):
        a, ka, b, kb, c, kc = np.broadcast_arrays(a, ka, b, kb, c, kc)
        ok = ((a == 0) | has[a]) & ((b == 0) | has[b]) & ((c == 0) | has[c])
        rows.append(np.stack([a, ka, b, kb, c, kc], axis=1)[ok])

    if has[window]:
        add(np.array([window]), 1, 0, 0, 0, 0)
    times = window // one
    rest = window - times * one
    add(one, times, rest, (rest > 0).astype(int), 0, 0)
    fewer = (times > 1) & (times * one < window)
    rest = window - (times[fewer] - 1) * one[fewer]
    add(one[fewer], times[fewer] - 1, np.minimum(rest, window), 1, 0, 0)
    low = one[one * 2 < window]
    add(window - low, 1, low, 1, 0, 0)
    b, c = np.meshgrid(one, one[one % grid == 0])
    b, c = b.ravel(), c.ravel()
    ok = (c < b) & (b + c < window) & (window - b - c > b)
    add(window - b[ok] - c[ok], 1, b[ok], 1, c[ok], 1)
    out = np.concatenate(rows) if rows else np.zeros((0, 6), dtype=np.int64)
    return np.unique(out, axis=0)


def solve_nnls(combos: np.ndarray, h: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """``x >= 0`` that brings ``A x`` near ``h``, by multiplicative updates;
    ``A`` is sparse, column ``j`` holds the times of combination ``j``."""
    lengths, times = combos[:, 0::2], combos[:, 1::2].astype(float)
    target = h.astype(float)
    pull = (times * target[lengths]).sum(axis=1)
    x = np.full(len(combos), max(target.sum(), 1.0) / max(len(combos), 1))
    for _ in range(steps):
        made = np.bincount(lengths.ravel(), weights=(times * x[:, None]).ravel(), minlength=len(h))
        x *= pull / np.maximum((times * made[lengths]).sum(axis=1), 1e-12)
    return x


def make_plan(histogram: dict[int, int], window: int) -> dict:
    """Intervals of ranks of each length, and where the stream of the rest
    lies.  The size depends on the window only."""
    h = np.zeros(window + 1, dtype=np.int64)
    for l, n in histogram.items():
        h[l] = n
    left, used = h.copy(), np.zeros_like(h)
    entries, sequences = [], 0      # (length, from, to, times, sequence, offset)

    def commit(parts, repeats):
        nonlocal sequences
        offset = 0
        for l, k in parts:
            entries.append((l, used[l], used[l] + k * repeats, k, sequences, offset))
            used[l] += k * repeats
            left[l] -= k * repeats
            offset += k * l
        sequences += repeats

    combos = combinations(np.flatnonzero(h), window)
    if len(combos):
        x = solve_nnls(combos, h)
        order = np.argsort(-x, kind="stable")
        for rounded in (True, False):             # rounded counts first, then what the rest allows
            for j in order:
                parts = [(int(combos[j, i]), int(combos[j, i + 1])) for i in (0, 2, 4) if combos[j, i + 1]]
                most = min(left[l] // k for l, k in parts)
                repeats = min(int(x[j]), most) if rounded else most
                if repeats > 0:
                    commit(parts, int(repeats))
    # residuals: longest first, filled up with the longest that still fits
    skip = np.zeros(window + 1, dtype=bool)
    while True:
        rest = np.flatnonzero((left > 0) & ~skip)
        if not len(rest):
            break
        take, room = {int(rest[-1]): 1}, window - int(rest[-1])
        for l in np.flatnonzero(left[:room + 1] > 0)[::-1].tolist():
            k = min(room // l, int(left[l]) - take.get(l, 0))
            if k > 0:
                take[l] = take.get(l, 0) + k
                room -= k * l
        if room <= GREEDY_WASTE:
            commit(list(take.items()), int(min(left[l] // k for l, k in take.items())))
        else:
            skip[rest[-1]] = True
    stream, at = [], 0
    for l in np.flatnonzero(left).tolist():
        stream.append((l, used[l], h[l], at))
        at += int(left[l]) * l
    tail = at % window
    sizes = [1 << b for b in range(window.bit_length(), -1, -1) if tail >> b & 1]
    entries.sort()
    cols = np.array(entries, dtype=np.int64).reshape(-1, 6).T
    smooth = np.array(stream, dtype=np.int64).reshape(-1, 4).T
    return {"window": window, "entries": cols, "stream": smooth, "sequences": sequences, "total": at,
            "borders": np.concatenate(([at - tail], at - tail + np.cumsum(sizes))).astype(np.int64) if tail else np.array([at], np.int64)}


PLACED = PIECES + ", sequence_id bigint, offset bigint, cut boolean"


def place(plan_data):
    """Sequence and offset of ranked pieces; those of the stream are cut."""

    def run(batches):
        plan = plan_data.value
        window, (lens, lo, hi, times, seq, off) = plan["window"], plan["entries"]
        key = (lens << 40) + lo
        s_len, s_from, _, s_at = plan["stream"]
        borders = plan["borders"]
        for batch in batches:
            t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "rank", "ids_crc32", "doc_tokens", "text_hash")}
            length, rank = t["length"], t["rank"]
            e = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            e0 = np.maximum(e, 0)
            fits = (e >= 0) & (lens[e0] == length) & (rank < hi[e0]) if len(lens) else np.zeros(len(rank), bool)
            n = len(rank)
            take, start, size = np.arange(n)[fits], t["start"][fits], length[fits]
            k = e0[fits]
            r = rank[fits] - lo[k] if len(lens) else rank[fits]
            sequence = seq[k] + r // times[k] if len(lens) else r
            offset = off[k] + r % times[k] * size if len(lens) else r
            whole = np.zeros(len(take), dtype=bool)
            rest = np.flatnonzero(~fits)
            if len(rest):
                j = np.searchsorted(s_len, length[rest])
                at = s_at[j] + (rank[rest] - s_from[j]) * length[rest]
                end = at + length[rest]
                body = borders[0]
                last = np.minimum(end, body) - 1
                rows, begin = [], []
                # borders inside each piece: multiples of the window, then those of the tail
                n_body = np.where(at < body, last // window - at // window, -1)
                pieces = np.where(at < body, n_body + 1, 0)
                rows.append(np.repeat(np.arange(len(rest)), pieces))
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (at // window)[rows[0]] + nth
                begin.append(np.maximum(at[rows[0]], first * window))
                for b in range(len(borders) - 1):
                    hit = np.flatnonzero((at < borders[b + 1]) & (end > borders[b]))
                    rows.append(hit)
                    begin.append(np.maximum(at[hit], borders[b]))
                owner, begin = np.concatenate(rows), np.concatenate(begin)
                in_body = begin < body
                tail = np.clip(np.searchsorted(borders, begin, side="right") - 1, 0, max(len(borders) - 2, 0))
                stop = np.where(in_body, (begin // window + 1) * window, borders[np.minimum(tail + 1, len(borders) - 1)])
                stop = np.minimum(stop, end[owner])
                base = np.where(in_body, begin // window * window, borders[tail])
                parts = np.bincount(owner, minlength=len(rest))
                take = np.concatenate([take, rest[owner]])
                start = np.concatenate([start, t["start"][rest][owner] + begin - at[owner]])
                size = np.concatenate([size, stop - begin])
                sequence = np.concatenate([sequence, plan["sequences"] + np.where(in_body, begin // window, body // window + tail)])
                offset = np.concatenate([offset, begin - base])
                whole = np.concatenate([whole, parts[owner] > 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(take)), pa.array(t["text_hash"][take]), pa.array(start), pa.array(size),
                 pa.array(t["ids_crc32"][take]), pa.array(t["doc_tokens"][take]), pa.array(sequence), pa.array(offset),
                 pa.array(whole)],
                names=["doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"])

    return run


def ranked(pieces: DataFrame, histogram: dict[int, int], window: int) -> DataFrame:
    """``rank`` of each piece among those of its length, dealt out by
    (length, salt): counts of the salts give where each begins."""
    salts = F.array(*[F.lit(histogram.get(l, 0) // RANK_GROUP + 1) for l in range(1, window + 1)])
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "start"),
                                             F.element_at(salts, F.col("length").cast("int"))))
    counts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "text_hash", "start")
    return (dealt.withColumn("nth", F.row_number().over(inside) - 1).join(begins, ["length", "salt"])
            .withColumn("rank", (F.col("begin") + F.col("nth")).cast("bigint")).drop("salt", "nth", "begin"))


def part_checksums(path: str, end_id: int):
    """Checksums of the parts of documents that were cut."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts, parts = batch.column("text").to_pylist(), batch.column("parts").to_pylist()
            rows, out = [], []
            for i, text in enumerate(texts):
                raw = coder.encode(text, end)
                for p in parts[i]:
                    rows.append(i)
                    out.append((p["start"], p["length"], zlib.crc32(raw[4 * p["start"]:4 * (p["start"] + p["length"])]),
                                p["doc_tokens"], p["sequence_id"], p["offset"]))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    path = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    small_batches(spark)
    texts = keyed(docs, doc_id, text)
    pieces = stage(texts.mapInArrow(cut_documents(path, window, end_id), PIECES), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).select(*OUT)
    plan = make_plan(histogram, window)
    placed = ranked(pieces, histogram, window).mapInArrow(place(spark.sparkContext.broadcast(plan)), PLACED)
    placed = stage(placed, "placed")
    part = F.struct("start", "length", "doc_tokens", "sequence_id", "offset")
    cut = placed.filter("cut").groupBy("doc_id", "text_hash").agg(F.collect_list(part).alias("parts"))
    # some documents only are cut; their list is broadcast when its size is small
    few = placed.filter("cut").count() <= BROADCAST_ROWS
    cut = (F.broadcast(cut) if few else cut).select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "parts")
    match = texts["doc_id"].eqNullSafe(F.col("cut_id")) & (texts["text_hash"] == F.col("cut_hash"))
    again = texts.join(cut, match).select("doc_id", "text_hash", "text", "parts").dropDuplicates(["doc_id", "text_hash"])
    again = again.mapInArrow(part_checksums(path, end_id), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
                             "doc_tokens bigint, sequence_id bigint, offset bigint")
    return placed.filter(~F.col("cut")).select(*OUT).unionByName(again)


def with_ids(docs: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text",
             tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The pieces with their token ids, ``ids array<int>``; for documents
    whose ids are unique."""
    path = tokenizer or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    @F.arrow_udf("array<int>")
    def slice_ids(texts: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        coder = encoder(path)
        return pa.array([np.frombuffer(coder.encode(t, end), "<u4")[s:s + n].astype(np.int32) for t, s, n in
                         zip(texts.to_pylist(), start.to_pylist(), length.to_pylist())], pa.list_(pa.int32()))

    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), full_text(text).alias("text"))
    return packed.join(texts, "doc_id").withColumn("ids", slice_ids("text", "start", "length")).drop("text")


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

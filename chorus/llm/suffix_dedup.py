"""Removal of repeated passages by suffix sorting.

Every byte is removed that lies in a string of ``min_len`` bytes which also
starts anywhere else; strings are judged on the input.

1. Equal texts are one class; a class of several long texts is removed
   whole, and one of them stands for it below.
2. Anchors.  Of the ``gram``-byte strings in each window of ``min_len``
   bytes the one with the least hash is an anchor, so equal windows have
   the same anchor at the same place.  Anchors whose hash occurs once are
   dropped, which loses nothing; the others bring their surroundings, all
   windows that hold them, to a task by hash.
3. Suffixes.  The surroundings of one anchor are aligned at it and coded in
   blocks of ``BLOCK`` bytes, a symbol naming content, column and anchor.
   The suffix array of the coded texts, built by linear grouping
   construction, gives for each place the longest run of blocks that occurs
   anywhere else.  A window whose covering blocks are within that run is
   repeated, one whose inner blocks are not is not; of the others, at the
   ends of repeated passages, the bytes are compared by hash.
4. Spans are merged by document and cut out.

An anchor with more than ``GROUP_CAP`` occurrences is dealt over salts.
Windows that find no equal within their salt are then compared across salts
by hash, dealt by hash, so no task gets all of a common passage.

Cases: null text is empty; texts shorter than ``min_len`` keep all bytes;
repeated rows are copies of each other; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import ByteHashes, full_text, mix64, slices_by_size, small_batches, table, utf8_buffers
from chorus.llm.grouping_sort import neighbour_matches, suffix_array
from chorus.plans.stage import stage

MIN_LEN = 400
GRAM_SHARE = 5                  # a gram is a fifth of the string's length
BLOCK = 64
GROUP_CAP = 2000
CHUNK = 1 << 20                 # bytes handled at a time; positions take 20 bits
TASK_CONTEXTS = 1500            # contexts sorted together, unless one group is larger
BUCKETS = 256
BROADCAST_ROWS = 300_000
BROADCAST_POSITIONS = 2_000_000


def anchors_of(data: np.ndarray, offsets: np.ndarray, min_len: int, gram: int):
    """``(row, position in the row, hash)`` of the anchors of every row."""
    rows, places, hashes = [], [], []
    for a, b in slices_by_size(offsets, CHUNK):
        lo, hi = int(offsets[a]), int(offsets[b])
        step = CHUNK - min_len
        for at in range(lo, max(hi - min_len + 1, lo + 1), step) if hi - lo > CHUNK else [lo]:
            part = data[at:min(at + CHUNK, hi)]
            row, place, h = _chunk_anchors(part, offsets[a:b + 1] - at, min_len, gram)
            rows.append(row + a)
            places.append(place)
            hashes.append(h)
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    keep = np.unique(np.stack([row, place]), axis=1, return_index=True)[1] if len(row) else np.zeros(0, np.int64)
    return row[keep], place[keep], h[keep]


def _chunk_anchors(data: np.ndarray, bounds: np.ndarray, min_len: int, gram: int):
    n, w = len(data), min_len - gram + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < min_len:
        return none
    at = np.arange(n - gram + 1)
    h = ByteHashes(data).ranges(at, at + gram)
    key = (h & ~np.uint64(CHUNK - 1)) | at.astype(np.uint64)       # least hash, leftmost on ties
    size = -(-len(key) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(key)] = key
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - min_len + 1)
    least = np.minimum(backward[starts], forward[starts + w - 1])
    # windows inside one row
    row = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + min_len <= bounds[np.minimum(row + 1, len(bounds) - 1)]
    pick = np.unique((least[inside] & np.uint64(CHUNK - 1)).astype(np.int64))
    row = np.searchsorted(bounds, pick, side="right") - 1
    return row, pick - bounds[row], h[pick]


def periodic_runs(row: np.ndarray, place: np.ndarray, h: np.ndarray, min_len: int, gram: int):
    """``(drop, row, start, stop)``.  Equal anchors at a steady distance of
    at most a gram lie in periodic text.  Where such a run holds every window
    twice, it is a span of its own; of its anchors the first two, whose
    windows show the whole period, stay for other texts to meet, and those
    whose windows reach past its end; the others go."""
    drop = np.zeros(len(row), dtype=bool)
    gap = np.diff(place)
    link = (np.diff(row) == 0) & (h[1:] == h[:-1]) & (gap <= gram)
    at = np.flatnonzero(link)
    if not len(at):
        z = np.zeros(0, np.int64)
        return drop, z, z, z
    new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(gap[at]) != 0)))
    head = at[new]
    tail = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1
    start, stop = place[head], place[tail] + gram
    long = stop - start >= min_len + gap[head]
    head, tail, start, stop = head[long], tail[long], start[long], stop[long]
    for a, b, end in zip(head.tolist(), tail.tolist(), stop.tolist()):
        drop[a + 2:b + 1] = place[a + 2:b + 1] + min_len <= end
    return drop, row[head], start, stop


def find_anchors(min_len: int, gram: int):
    """Anchors, and with a null anchor the spans of periodic runs."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8_buffers(batch.column("text"))
            row, place, h = anchors_of(data, offsets, min_len, gram)
            drop, r, start, stop = periodic_runs(row, place, h, min_len, gram)
            row, place, h = row[~drop], place[~drop], h[~drop]
            n, k = len(row), len(r)
            none = np.ones(n + k, dtype=bool)
            none[:n] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h.view(np.int64), np.zeros(k, np.int64)]), mask=none),
                 batch.column("ref").take(pa.array(np.concatenate([row, r]))), pa.array(np.concatenate([place, start])),
                 pa.array(np.concatenate([np.zeros(n, np.int64), stop]), mask=~none)], names=["anchor", "ref", "pos", "stop"])

    return run


def cut_contexts(min_len: int, left: int):
    """The surroundings of the given anchors of each text."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py().encode()
                ref, spots = batch.column("ref")[r].as_py(), batch.column("spots")[r].as_py()
                cols = ([], [], [], [], [], [])
                for s in spots:
                    p = s["pos"]
                    begin = max(0, p - left)
                    for c, x in zip(cols, (s["anchor"], (ref ^ p * 0x9E3779B1) % s["salts"], ref, p, p - begin, text[begin:p + min_len])):
                        c.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)] + [pa.array([s["salts"] for s in spots], pa.int32())],
                                                 names=["anchor", "salt", "ref", "pos", "ahead", "context", "salts"])

    return run


def repeated_windows(group: np.ndarray, ahead: np.ndarray, text: np.ndarray, offsets: np.ndarray, min_len: int, left: int):
    """For aligned contexts: which windows exist, which are repeated in their
    group, and a hash of each window's place (``None`` where not asked).
    Columns are the window starts ``-left .. 0`` before the anchor."""
    m, hashes = len(group), ByteHashes(text)
    size, begin = np.diff(offsets), offsets[:-1]
    back, fore = -(-left // BLOCK), -(-min_len // BLOCK)
    column = np.arange(-back, fore)
    lo = np.clip(ahead[:, None] + column * BLOCK, 0, size[:, None])
    hi = np.clip(ahead[:, None] + (column + 1) * BLOCK, 0, size[:, None])
    name = mix64(group.astype(np.uint64)[:, None] * np.uint64(64) + (column + back).astype(np.uint64))
    symbol = mix64(hashes.ranges(begin[:, None] + lo, begin[:, None] + hi) ^ name)
    empty = (hi <= lo).ravel()
    ids, count = np.unique(symbol.ravel(), return_inverse=True, return_counts=True)[1:]
    ids = np.where((count[ids] > 1) & ~empty, ids + 2, 1).reshape(m, -1)        # 1: a symbol of one place ends a run
    ids = np.concatenate([ids, np.ones((m, 1), dtype=np.int64)], axis=1)
    keep = (ids > 1) | np.concatenate([np.zeros((m, 1), bool), ids[:, :-1] > 1], axis=1)
    sequence = np.append(ids[keep], 0)
    run = np.zeros(ids.shape, dtype=np.int64)
    run[keep] = neighbour_matches(sequence, suffix_array(sequence), 1)[:-1]
    start = np.arange(-left, 1)
    exists = (ahead[:, None] + start >= 0) & (ahead[:, None] + start + min_len <= size[:, None])
    first_out, last_out = start // BLOCK, -(-(start + min_len) // BLOCK)
    first_in, last_in = -(-start // BLOCK), (start + min_len) // BLOCK
    repeated = exists & (run[:, first_out + back] >= last_out - first_out)
    possible = exists & (run[:, first_in + back] >= last_in - first_in)
    # ends of passages: compare bytes, in the (group, start) cells that hold a doubtful window
    doubtful = possible & ~repeated
    if doubtful.any():
        names, g = np.unique(group, return_inverse=True)
        cells = np.zeros((len(names), len(start)), dtype=bool)
        np.logical_or.at(cells, g, doubtful)
        r, c = np.nonzero(possible & cells[g])
        at = begin[r] + ahead[r] + start[c]
        key = mix64(hashes.ranges(at, at + min_len) ^ mix64(g[r].astype(np.uint64) * np.uint64(1 << 12) + c.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(key), dtype=bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        repeated[r[hit], c[hit]] = True
    return exists, repeated, hashes


SPANS = "kind int, ref bigint, start bigint, stop bigint, packed binary"
WINDOW = np.dtype([("hash", "<u8"), ("ref", "<i8"), ("start", "<i8"), ("alone", "?")])


def settle(cols: dict, min_len: int, left: int):
    """Spans of the contexts of whole groups, and the windows of salted
    groups that are to be compared across salts, packed by hash bucket."""
    sizes = np.array([len(c) for c in cols["context"]])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    text = np.frombuffer(b"".join(cols["context"]), dtype=np.uint8)
    ahead, ref, pos, salts = (np.array(cols[c], dtype=np.int64) for c in ("ahead", "ref", "pos", "salts"))
    named = mix64(np.array(cols["anchor"], dtype=np.int64).view(np.uint64) ^ mix64(np.array(cols["salt"], dtype=np.uint64) + np.uint64(7)))
    group = np.unique(named, return_inverse=True)[1]
    whole = mix64(ByteHashes(text).ranges(offsets[:-1], offsets[1:]) ^ mix64(group.astype(np.uint64) * np.uint64(4096) + ahead.astype(np.uint64)))
    first, same, copies = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)[1:]
    # equal contexts: one is sorted, all its windows are repeated
    part = np.concatenate([text[offsets[i]:offsets[i + 1]] for i in first])
    bounds = np.concatenate(([0], np.cumsum(sizes[first]))).astype(np.int64)
    exists, repeated, hashes = repeated_windows(group[first], ahead[first], part, bounds, min_len, left)
    repeated |= exists & (copies > 1)[:, None]
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1] - 1
    runs = np.bincount(r, minlength=len(first))
    begins = np.cumsum(runs) - runs
    times = runs[same]
    who = np.repeat(np.arange(len(same)), times)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + begins[same][who]
    start, stop = pos[who] - left + a[nth], pos[who] - left + b[nth] + min_len
    packed = []
    salted = salts[first] > 1
    if salted.any():
        r, c = np.nonzero(exists & salted[:, None])
        at = bounds[r] + ahead[first][r] - left + c
        w = np.zeros(len(r), dtype=WINDOW)
        w["hash"], w["ref"], w["start"], w["alone"] = hashes.ranges(at, at + min_len), ref[first][r], pos[first][r] - left + c, ~repeated[r, c]
        # all that are alone, and of the others two of each: one may be the very window it is compared with
        w = w[np.lexsort((w["start"], w["ref"], w["alone"], w["hash"]))]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w["hash"][1:] != w["hash"][:-1]) | (w["alone"][1:] != w["alone"][:-1])
        w = w[w["alone"] | new | np.append(new[1:], True)]
        bucket = (w["hash"] >> np.uint64(32)) % np.uint64(BUCKETS)
        for k in np.unique(bucket):
            packed.append((int(k), w[bucket == k].tobytes()))
    return ref[who], start, stop, packed


def settle_groups(min_len: int, left: int):
    names = ("anchor", "salt", "ref", "pos", "ahead", "context", "salts")

    def emit(cols):
        ref, start, stop, packed = settle(cols, min_len, left)
        n, k = len(ref), len(packed)
        return pa.RecordBatch.from_arrays(
            [pa.array([0] * n + [1] * k, pa.int32()), pa.array(ref.tolist() + [p[0] for p in packed], pa.int64()),
             pa.array(start.tolist() + [None] * k, pa.int64()), pa.array(stop.tolist() + [None] * k, pa.int64()),
             pa.array([None] * n + [p[1] for p in packed], pa.binary())], names=["kind", "ref", "start", "stop", "packed"])

    def run(batches):
        held = {c: [] for c in names}
        for batch in (b.slice(a, TASK_CONTEXTS) for b in batches for a in range(0, b.num_rows, TASK_CONTEXTS)):
            for c in names:
                held[c].extend(batch.column(c).to_pylist())
            n = len(held["anchor"])
            if n >= TASK_CONTEXTS:
                # all but the last group are complete
                last = (held["anchor"][-1], held["salt"][-1])
                cut = n
                while cut and (held["anchor"][cut - 1], held["salt"][cut - 1]) == last:
                    cut -= 1
                if cut:
                    yield emit({c: held[c][:cut] for c in names})
                    held = {c: held[c][cut:] for c in names}
        if held["anchor"]:
            yield emit(held)

    return run


def compare_salts(min_len: int):
    """Windows that were alone in their salt and have an equal in another."""

    def run(batches):
        parts = [np.frombuffer(p, dtype=WINDOW) for batch in batches for p in batch.column("packed").to_pylist()]
        if not parts:
            return
        w = np.concatenate(parts)
        # one window may come by several of its anchors: it is no equal of itself
        w = w[np.lexsort((w["start"], w["ref"], w["hash"]))]
        fresh = np.ones(len(w), dtype=bool)
        fresh[1:] = (w["hash"][1:] != w["hash"][:-1]) | (w["ref"][1:] != w["ref"][:-1]) | (w["start"][1:] != w["start"][:-1])
        w = w[fresh]
        same = w["hash"][1:] == w["hash"][:-1]
        hit = np.zeros(len(w), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        w = w[hit & w["alone"]]
        w = w[np.lexsort((w["start"], w["ref"]))]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w["ref"][1:] != w["ref"][:-1]) | (w["start"][1:] > w["start"][:-1] + min_len)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(w)) - 1 if len(w) else at
        yield pa.RecordBatch.from_arrays([pa.array(w["ref"][at]), pa.array(w["start"][at]), pa.array(w["start"][last] + min_len)],
                                         names=["ref", "start", "stop"])

    return run


def merged(spans: list) -> list:
    """Maximal runs of the bytes in the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def text_ref(t: Column) -> Column:
    """Sixty bits of the text's SHA-256 name it."""
    return F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, group_cap: int = GROUP_CAP):
    """``(rows, copies, spans)``: the documents as ``doc_id, ref, text``, the
    classes of several long texts, and the merged spans of the texts that
    stand alone, ``ref, spans``.  Nothing of a text is in the last two."""
    small_batches(docs.sparkSession)
    gram = min_len // GRAM_SHARE
    left = min_len - gram
    t = full_text(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.octet_length(t).cast("bigint").alias("n_bytes"),
                       text_ref(t).alias("ref"))
    long = rows.filter(F.col("n_bytes") >= min_len)
    copies = stage(long.groupBy("ref", "n_bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("stands")).filter("copies > 1"), "copies")
    few = copies.count() <= BROADCAST_ROWS
    held = copies.select("ref", "stands", "copies")
    one = long.join(F.broadcast(held) if few else held, "ref", "left").filter(
        F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("stands"))).select("ref", "text")
    anchors = one.mapInArrow(find_anchors(min_len, gram), "anchor bigint, ref bigint, pos bigint, stop bigint")
    made = stage(anchors, "anchors")        # counted and joined: read twice, made once
    anchors = made.filter("anchor is not null").select("anchor", "ref", "pos")
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select(
        "anchor", F.ceil(F.col("n") / group_cap).cast("int").alias("salts"))
    spots = anchors.join(often, "anchor").groupBy("ref").agg(F.collect_list(F.struct("anchor", "pos", "salts")).alias("spots"))
    spots = stage(spots, "spots")
    most = spots.agg(F.coalesce(F.max(F.array_max("spots.salts")), F.lit(1)).alias("salts")).first()
    contexts = one.join(spots, "ref").mapInArrow(
        cut_contexts(min_len, left), "anchor bigint, salt int, ref bigint, pos bigint, ahead int, context binary, salts int")
    contexts = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = stage(contexts.mapInArrow(settle_groups(min_len, left), SPANS), "spans")
    spans = found.filter("kind = 0").select("ref", "start", "stop").unionByName(
        made.filter("anchor is null").select("ref", F.col("pos").alias("start"), "stop"))
    if most.salts > 1:
        across = found.filter("kind = 1").select(F.col("ref").cast("int").alias("bucket"), "packed").repartition(BUCKETS, "bucket")
        spans = spans.unionByName(across.mapInArrow(compare_salts(min_len), "ref bigint, start bigint, stop bigint"))

    @F.arrow_udf("array<struct<start:bigint,stop:bigint>>")
    def merge(column: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in x])] for x in column.to_pylist()],
                        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))

    spans = spans.distinct().groupBy("ref").agg(F.collect_list(F.struct("start", "stop")).alias("s")).select("ref", merge("s").alias("spans"))
    return rows, copies, stage(spans, "merged-spans")


def all_cuts(copies: DataFrame, spans: DataFrame):
    """``ref, spans`` of every text that loses bytes, and whether the table
    is short enough to be broadcast."""
    gone = copies.select("ref", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    cuts = gone.unionByName(spans.join(gone, "ref", "left_anti"))
    size = cuts.agg(F.count("*").alias("r"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n")).first()
    return cuts, size.r <= BROADCAST_ROWS and size.n <= BROADCAST_POSITIONS


def without(raw: bytes, spans: list | None) -> bytes:
    if not spans:
        return raw
    ends = [0] + [x["stop"] for x in spans]
    return b"".join(raw[a:b] for a, b in zip(ends, [x["start"] for x in spans] + [len(raw)]))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: str = "n_chars", min_len: int = MIN_LEN) -> DataFrame:
    """The documents with the repeated passages cut from their texts (bytes
    of a character cut in two go with them) and ``chars``, if there, counted
    anew; documents of which nothing is left go."""
    rows, copies, spans = repeated_spans(docs, doc_id, text, min_len)
    cuts, few = all_cuts(copies, spans)
    cuts = cuts.select(F.col("ref").alias("_cut_ref"), F.col("spans").alias("_cut_spans"))

    @F.arrow_udf("string")
    def left_over(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without(t.as_py().encode(), s).decode("utf-8", "ignore") for t, s in zip(texts, spans.to_pylist())], pa.string())

    out = docs.join(F.broadcast(cuts) if few else cuts, text_ref(full_text(text)) == F.col("_cut_ref"), "left")
    # not deterministic: else the filter has the texts cut a second time, by a second Python worker in each task
    cut_text = left_over.asNondeterministic()(full_text(text), "_cut_spans")
    cut = out.filter("_cut_ref is not null").withColumn(text, cut_text).filter(F.length(text) > 0)
    if chars in docs.columns:
        cut = cut.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType))
    return out.filter("_cut_ref is null").select(*docs.columns).unionByName(cut.select(*docs.columns))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, group_cap: int = GROUP_CAP) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` (the remaining bytes) of every
    document."""
    rows, copies, spans = repeated_spans(docs, doc_id, text, min_len, group_cap)
    cuts, small = all_cuts(copies, spans)
    out = rows.join(F.broadcast(cuts) if small else cuts, "ref", "left")

    @F.arrow_udf("binary")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [without(t.as_py().encode(), s) for t, s in zip(texts, spans.to_pylist())]
        return pa.array(out, pa.binary())

    kept = F.when(F.col("spans").isNull(), F.col("text").cast("binary")).otherwise(cut("text", "spans"))
    return out.select("doc_id", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"), kept.alias("kept"))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, group_cap: int = GROUP_CAP) -> DataFrame:
    out = remove_repeats(docs, doc_id, text, min_len, group_cap)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))

"""WARC archives: write captures, read them back, and merge their indexes.

Writing.  Captures whose payloads are equal (length and SHA-1) are grouped;
the one with the largest ``page_id`` is a ``response``, the others are
``revisit`` records that refer to it.  Each task sorts its captures by URL
key, time and id and writes them as one gzip-compressed WARC 1.1 file: the
text writer's line separator is the blank line that ends a record, so any
file system that Spark reaches will do.

Reading.  The same separator cuts a file into chunks, of which a streaming
parser rebuilds the records by their ``Content-Length``; a record's payload
is hashed again and must agree with its header.

Index.  Every archive gives a run of index entries that is sorted already.
Runs are dealt out by ranges of (URL key, time, id), and each range is
merged from its runs by a loser tree, which yields the capture histories in
global order: range by range, and by ``order_no`` within a range.  A URL
that holds a large share of the captures is spread over ranges by time.

Cases: null html is an empty payload; payloads shorter than ``min_bytes``
are always responses; rows that repeat id and payload are responses each;
null or odd URLs have an empty or as-is key; a page without an id is written
as such and comes back with null; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import table
from chorus.plans.stage import stage
from chorus.session import scratch_path

BLANK = "\r\n\r\n"
FIRST_CAPTURE = 1_700_000_000            # time of page 0; pages carry no time of their own
MIN_BYTES = 0
ENTRIES_PER_RANGE = 100_000
INDEX = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
         "url_key string, capture_time string, run string, record_no bigint")


def base32_sha1(c: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight digits of base 32 for each
    forty bits."""
    hexed = F.sha1(c)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the right, then path and query: ``com,example)/a``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1), r"[\r\n]+", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), path)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    i, payload = F.col(page_id).cast("bigint"), F.coalesce(F.col(html), F.lit("")).cast("binary")
    seconds = (F.lit(FIRST_CAPTURE) + F.coalesce(i, F.lit(0))).cast("timestamp")
    return pages.select(i.alias("page_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "").alias("url"),
                        url_key(F.col(url)).alias("url_key"), payload.alias("payload"),
                        F.octet_length(payload).cast("bigint").alias("payload_bytes"), base32_sha1(payload).alias("digest"),
                        F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))


def record(c: dict) -> Column:
    """A whole WARC record as bytes in a string column, without the blank
    line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    uri = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    revisit = c["refers_to"].isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    c["payload_bytes"].cast("string"), F.lit(BLANK))
    body = F.when(revisit, F.lit("")).otherwise(c["payload"].cast("string"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        line("WARC-Record-ID", uri(c["page_id"])), line("WARC-Date", c["time"]), line("WARC-Target-URI", c["url"]),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c["digest"])),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", uri(c["refers_to"])))).otherwise(F.lit("")),
        line("X-URL-Key", c["url_key"]), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(BLANK))
    return F.concat(head, http, body)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = MIN_BYTES) -> str:
    """Write the captures as WARC files below ``path``."""
    rows = captures(pages, page_id, url, html)
    same = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
            .agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    out = rows.join(same, ["digest", "payload_bytes"], "left")
    refers = F.when(~F.col("best").eqNullSafe(F.col("page_id")), F.col("best"))
    out = out.withColumn("refers_to", refers).sortWithinPartitions("url_key", "time", "page_id")
    cols = {n: F.col(n) for n in ("page_id", "url", "url_key", "payload", "payload_bytes", "digest", "time", "refers_to")}
    out.select(record(cols).alias("value")).write.option("lineSep", BLANK).option("compression", "gzip").text(path)
    return path


class RecordReader:
    """Rebuilds the records of one archive from its bytes in order."""

    def __init__(self):
        self.held, self.need, self.head = bytearray(), None, None

    def feed(self, data: bytes):
        self.held += data
        while True:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.held[:end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
                self.need = int(self.head[b"content-length"])
                del self.held[:end + 4]
            if len(self.held) < self.need + 4:
                return
            block = bytes(self.held[:self.need])
            del self.held[:self.need + 4]
            head, self.head = self.head, None
            yield head, block


def _page(uri: bytes | None):
    if uri is None:
        return None
    name = uri.strip(b"<>").rpartition(b":")[2]
    return None if name == b"none" else int(name)


def parse(batches):
    """Index entries of the records in the chunks of whole archives."""
    name, reader, number = None, None, 0
    for batch in batches:
        rows = []
        for file, chunk in zip(batch.column("file").to_pylist(), batch.column("chunk").to_pylist()):
            if file != name:
                name, reader, number = file, RecordReader(), 0
            for head, block in reader.feed((chunk or b"") + b"\r\n\r\n"):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length:")[2])
                digest = head[b"warc-payload-digest"].partition(b":")[2].decode()
                kind = head[b"warc-type"].decode()
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {head[b'warc-record-id']!r} in {name} does not fit its header")
                rows.append((_page(head[b"warc-record-id"]), size, digest, kind, _page(head.get(b"warc-refers-to")),
                             head[b"x-url-key"].decode(), head[b"warc-date"].decode(), name, number))
                number += 1
        cols = list(zip(*rows)) if rows else [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "run", "record_no"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index entry per record of the archives below ``path``."""
    chunks = spark.read.option("lineSep", BLANK).text(path)
    return chunks.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("chunk")).mapInArrow(parse, INDEX)


class LoserTree:
    """K-way merge: inner nodes hold the losers of their matches, so each
    step replays one path from a leaf to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.lost = [-1] * self.k
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _head(self, run: int):
        i = self.at[run]
        return self.runs[run][i] if i < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.lost[node]
            if other < 0:                       # first to arrive waits for its match
                self.lost[node] = winner
                return
            if self._before(other, winner):
                self.lost[node], winner = winner, other
            node //= 2
        self.lost[0] = winner

    def __iter__(self):
        while self.runs:
            run = self.lost[0]
            head = self._head(run)
            if head is None:
                return
            yield head
            self.at[run] += 1
            self._replay(run)


def merge_range(batches):
    """The runs of one range merged into one order."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    if not t.num_rows:
        return
    lowest = -(1 << 63)
    keys = zip(t["url_key"].to_pylist(), t["capture_time"].to_pylist(),
               (lowest if i is None else i for i in t["page_id"].to_pylist()), t["run"].to_pylist(), t["record_no"].to_pylist())
    runs: dict[str, list] = {}
    for row, key in enumerate(keys):
        runs.setdefault(key[3], []).append((*key, row))
    for run in runs.values():
        run.sort(key=lambda e: e[4])            # a run's slices may arrive out of turn; record numbers restore its order
    order = np.fromiter((e[5] for e in LoserTree([runs[k] for k in sorted(runs)])), dtype=np.int64, count=t.num_rows)
    yield t.take(pa.array(order)).append_column("order_no", pa.array(np.arange(len(order)))).combine_chunks().to_batches()[0]


def merge_indexes(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """Capture histories in global order: the entries with ``order_part``
    (range) and ``order_no`` within it."""
    if ranges is None:
        parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(parts, entries.count() // ENTRIES_PER_RANGE)
    dealt = entries.repartitionByRange(ranges, "url_key", "capture_time", "page_id", "run", "record_no")
    return dealt.mapInArrow(merge_range, INDEX + ", order_no bigint").withColumn("order_part", F.spark_partition_id())


def archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
            min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives, read them back and merge their indexes."""
    spark = pages.sparkSession
    path = write_archives(pages, path or scratch_path(spark, "warc"), page_id, url, html, min_bytes)
    return merge_indexes(stage(read_archives(spark, path), "warc-index"))


def op6_warc(spark, sf_dir):
    out = archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time",
                      "order_part", "order_no")

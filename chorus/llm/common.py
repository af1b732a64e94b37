"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAPS = np.zeros(256, dtype=bool)
WORD_GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of ``BATCH_ROWS`` rows, a tenth of
    Spark's default, unless the session says otherwise: a batch is held on
    both sides of the pipe, and texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def full_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def worker_state(name: str, make, model: bool = True):
    """A value kept in a Python worker process, so that tasks that follow
    each other in one worker share it.  A worker keeps one model at a time:
    the next operator's takes the place of the last one's."""
    home = sys.modules.setdefault("_chorus_worker_state", types.ModuleType("_chorus_worker_state"))
    held = home.__dict__.setdefault("held", {})
    if name not in held:
        if model:
            for other in [k for k, v in held.items() if v[0]]:
                del held[other]
        held[name] = (model, make())
    return held[name][1]


def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary Arrow array without a
    copy of the texts; row ``i`` is ``bytes[offsets[i]:offsets[i + 1]]``,
    null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=n + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices_by_size(offsets: np.ndarray, most: int):
    """Row ranges ``(a, b)`` that cover all rows in order, each holding at
    most ``most`` bytes unless a single row is longer."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (bijective), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D          # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64) if n else out


def _power_tables(n: int):
    """Powers of the base and of its inverse, grown as longer inputs come."""
    held = worker_state("powers", lambda: {"n": 0}, model=False)
    if held["n"] < n:
        held["n"] = max(n, 1 << 16)
        held["up"], held["down"] = powers(held["n"], BASE), powers(held["n"], BASE_INVERSE)
    return held["up"], held["down"]


class ByteHashes:
    """Hashes of any byte ranges of one buffer: a polynomial over the ring of
    64-bit integers whose digits are random 64-bit codes of the bytes, from
    prefix sums; equal ranges have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODES):
        self.up, self.down = _power_tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(codes[data] * self.up[:len(data)], out=self.prefix[1:], dtype=np.uint64)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.down[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every row and
    the number of words before each row: ``(starts, ends, first)``."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~WORD_GAPS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    begins[at] = inside[at]                       # a row's first byte begins a word of its own
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i + 1]]``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element under ``bounds``."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

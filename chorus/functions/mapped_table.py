"""A table of numbers by string key that the Python workers of an executor share.

The first worker that needs it turns its parquet files, on the executor's own
disk, into plain arrays beside the first of them: 64-bit key hashes in
ascending order, the keys' bytes and the values.  All workers map these files
read-only, so the machine holds their pages once however many workers there
are.  Other workers wait for the first at a file lock; the arrays are renamed
into place whole, so a worker that is lost while it builds leaves nothing that
another would take for a table.

Keys are compared byte by byte after their hashes, so equal hashes of
different keys are told apart.  Rows are built a file at a time: beside the
hashes, 16 bytes a key, a builder holds one parquet file.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import uuid

import numpy as np


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


class MappedTable:
    def __init__(self, folder: str):
        load = lambda name: np.asarray(np.load(f"{folder}/{name}.npy", mmap_mode="r"))
        self.hashes, self.starts, self.ends = load("hashes"), load("starts"), load("ends")
        self.rows, self.values = load("rows"), load("values")
        self.bytes = np.asarray(np.memmap(f"{folder}/bytes", dtype=np.uint8, mode="r")) if os.path.getsize(f"{folder}/bytes") else np.zeros(0, np.uint8)

    @staticmethod
    def rows_of(parquet: list[str], columns: list[str]) -> np.ndarray:
        import pyarrow.dataset as ds
        t = ds.dataset(parquet, format="parquet").to_table(columns=columns)
        return np.column_stack([t[c].to_numpy() for c in columns]).astype(np.float64)

    @classmethod
    def of_parquet(cls, parquet: list[str], key: str, columns: list[str]) -> MappedTable:
        folder = parquet[0] + ".mapped"
        with open(folder + ".lock", "a") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)            # let go when the file is closed, or its worker lost
            if not os.path.isdir(folder):
                draft = f"{folder}-{uuid.uuid4().hex[:8]}"
                os.makedirs(draft)
                try:
                    cls._build(parquet, key, columns, draft)
                    os.rename(draft, folder)
                except BaseException:
                    shutil.rmtree(draft, ignore_errors=True)
                    raise
        return cls(folder)

    @staticmethod
    def _build(parquet: list[str], key: str, columns: list[str], folder: str) -> None:
        import pyarrow.dataset as ds
        data = ds.dataset(parquet, format="parquet")
        n = data.count_rows()
        values = np.lib.format.open_memmap(f"{folder}/values.npy", mode="w+", dtype=np.float64, shape=(n, len(columns)))
        hashes, sizes, at = np.zeros(n, np.uint64), np.zeros(n, np.int64), 0
        with open(f"{folder}/bytes", "wb") as out:
            for batch in data.to_batches(columns=[key, *columns]):
                if not batch.num_rows:
                    continue
                keys = [k.encode() for k in batch.column(0).to_pylist()]
                part = slice(at, at + len(keys))
                hashes[part], sizes[part] = _hashes(keys), [len(k) for k in keys]
                for c in range(len(columns)):
                    values[part, c] = batch.column(c + 1).to_numpy(zero_copy_only=False)
                out.write(b"".join(keys))
                at += len(keys)
        values.flush()
        order, ends = np.argsort(hashes, kind="stable"), np.cumsum(sizes)
        for name, a in (("hashes", hashes[order]), ("rows", order), ("starts", (ends - sizes)[order]), ("ends", ends[order])):
            np.save(f"{folder}/{name}.npy", a)

    def find(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For every known word of every list, in order: its row of
        ``values`` and the number of its list.  Each different word of the
        batch is looked up once."""
        ids: dict[str, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for ws in lists for w in ws), dtype=np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
        keys = [w.encode() for w in ids]
        found = np.full(len(keys), -1, np.int64)
        if keys and len(self.hashes):
            hashes, sizes = _hashes(keys), np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
            joined, begins = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(sizes) - sizes
            lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
            for k in range(int((hi - lo).max())):       # more than one round only if hashes agree
                i = np.flatnonzero((lo + k < hi) & (found < 0))
                j = lo[i] + k
                alike = self.ends[j] - self.starts[j] == sizes[i]
                i, j = i[alike], j[alike]
                n = sizes[i]
                ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                differs = self.bytes[np.repeat(self.starts[j], n) + ramp] != joined[np.repeat(begins[i], n) + ramp]
                same = np.bincount(np.repeat(np.arange(len(i)), n), weights=differs, minlength=len(i)) == 0
                found[i[same]] = self.rows[j[same]]
        place = found[word] if len(keys) else np.zeros(0, np.int64)
        return place[place >= 0], owner[place >= 0]

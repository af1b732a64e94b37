"""The few file operations needed, through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Files of the file system that ``root`` lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def make(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def read(self, p: str) -> str | None:
        if not self.fs.exists(self.path(p)):
            return None
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def drop(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def listing(self, p: str) -> list:
        path = self.path(p)
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    def files(self, p: str):
        """``(path, length, time)`` of every file below a path."""
        for s in self.listing(p):
            if s.isDirectory():
                yield from self.files(s.getPath().toString())
            else:
                yield s.getPath().toString(), s.getLen(), s.getModificationTime()

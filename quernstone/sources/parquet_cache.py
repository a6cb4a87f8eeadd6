"""Parquet columns kept on the executors' disks between queries, bounded by bytes, least recently used out first.

Cached blocks are Spark's own (DISK_ONLY): a lost executor's blocks are read from
the source again, and a file that changed is another entry.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from quernstone.sources.patterns import list_files


class ParquetCache:
    def __init__(self, spark: SparkSession, limit_bytes: int = 64 << 30):
        self.spark, self.limit = spark, limit_bytes
        self.held: OrderedDict[tuple, tuple[DataFrame, int]] = OrderedDict()

    def _stamp(self, path: str) -> tuple:
        """Names, sizes and times of the files: a changed source isn't served from the cache."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        one = fs.getFileStatus(hadoop(path))
        files = [one] if one.isFile() else [fs.getFileStatus(hadoop(f)) for f in list_files(self.spark, path)]
        return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)

    def read(self, path: str, columns: list[str] | None = None) -> DataFrame:
        """The table, or some columns of it; kept on disk as far as a query reads it."""
        stamp = self._stamp(path)
        key = (path, tuple(columns or ()), stamp)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        for old in [k for k in self.held if k[:2] == key[:2]]:  # an earlier state of the same files
            self.drop(old)
        df = self.spark.read.parquet(path)
        df = (df.select(*columns) if columns else df).persist(StorageLevel.DISK_ONLY)
        self.held[key] = (df, sum(n for _, n, _ in stamp))
        while sum(n for _, n in self.held.values()) > self.limit and len(self.held) > 1:
            self.drop(next(iter(self.held)))
        return df

    def drop(self, key: tuple) -> None:
        self.held.pop(key)[0].unpersist()

    def info(self) -> list[tuple[str, str, int, int, str]]:
        """(path, columns, files, bytes of the source, storage) of every entry, the most recently used last."""
        return [(k[0], ",".join(k[1]) or "*", len(k[2]), n, str(df.storageLevel)) for k, (df, n) in self.held.items()]

"""Continuously updated tables on Structured Streaming.

``KeyedTable`` keeps a keyed replica of a change stream: each micro-batch is
reduced to the last change of each key and written as a delta; readers merge the
base with the deltas and see whole versions only; every few deltas are folded
into a new base.  ``ingest`` appends a stream to files with a time column.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_changes(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key, by one combined aggregation."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


class Folder:
    """Small files in a folder of any store that Spark reads, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        out = self.fs.create(self.at(f"{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(self.at(f"{name}.tmp"), self.at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if self.fs.exists(self.at("")) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class KeyedTable:
    """A keyed table of versions in a folder; the newest complete version is current.

    A version is a file that names a base and its deltas, so a micro-batch writes
    its own changes only; after ``fold`` deltas a new base is written.  The last
    ``keep`` versions stay readable, what older ones used is removed.  Changes may
    come out of order: of a stored row and a change the later by ``order`` wins,
    and deletions are kept as marks that readers don't see.
    """

    def __init__(self, folder: str, keys: list[str], order: str, op: str = "op", fold: int = 8, keep: int = 2):
        self.folder, self.keys, self.order, self.op, self.fold, self.keep = folder, keys, order, op, fold, keep

    def _versions(self, files: Folder) -> list[str]:
        return [n for n in files.names() if n.startswith("version-") and not n.endswith(".tmp")]

    def _parts(self, files: Folder) -> list[str]:
        found = self._versions(files)
        return json.loads(files.read(found[-1])) if found else []

    def _stored(self, spark: SparkSession, parts: list[str]) -> DataFrame | None:
        if not parts:
            return None
        rows = spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])
        return rows if len(parts) == 1 else last_changes(rows, self.keys, self.order)

    def read(self, spark: SparkSession) -> DataFrame | None:
        stored = self._stored(spark, self._parts(Folder(spark, self.folder)))
        return None if stored is None else stored.filter(F.col(self.op) != "delete").drop(self.op)

    def info(self, spark: SparkSession) -> dict:
        """Newest version, its base and deltas, and the versions that can be read."""
        files = Folder(spark, self.folder)
        found, parts = self._versions(files), self._parts(files)
        return {"version": found[-1] if found else None, "base": next((p for p in parts if p.startswith("base-")), None), "deltas": sum(p.startswith("delta-") for p in parts), "versions": len(found)}

    def _publish(self, files: Folder, epoch: int, parts: list[str]) -> None:
        files.write_new(f"version-{epoch:010d}", json.dumps(parts))
        found = self._versions(files)
        for old in found[: -self.keep]:
            files.remove(old)
        used = {p for v in found[-self.keep :] for p in json.loads(files.read(v))}
        for name in files.names():
            if name.startswith(("base-", "delta-")) and name not in used:
                files.remove(name)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Merges a micro-batch; the same epoch twice changes nothing more."""
        spark = batch.sparkSession
        files = Folder(spark, self.folder)
        found = self._versions(files)
        if found and found[-1] >= f"version-{epoch:010d}":
            return
        parts = self._parts(files)
        changes = last_changes(batch, self.keys, self.order)
        if len(parts) > self.fold:
            name = f"base-{epoch:010d}"
            last_changes(changes.unionByName(self._stored(spark, parts)), self.keys, self.order).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            parts = [name]
        else:
            name = f"delta-{epoch:010d}"
            changes.write.mode("overwrite").parquet(f"{self.folder}/{name}")
            parts = [*parts, name]
        self._publish(files, epoch, parts)

    def truncate(self, spark: SparkSession) -> None:
        """A new version without rows."""
        files = Folder(spark, self.folder)
        found, parts = self._versions(files), self._parts(files)
        if not found:
            return
        epoch = int(found[-1].removeprefix("version-"))
        name = f"base-{epoch:010d}-empty"
        self._stored(spark, parts).limit(0).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        files.remove(found[-1])
        self._publish(files, epoch, [name])

    def start(self, stream: DataFrame, checkpoint: str, mode: str = "append") -> StreamingQuery:
        return stream.writeStream.outputMode(mode).foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, ts_column: str, tag: str | None = None) -> StreamingQuery:
    """Appends a stream to Parquet files by day, with an optional tag column."""
    df = stream.withColumn("day", F.to_date(ts_column))
    if tag is not None:
        df = df.withColumn("tag", F.lit(tag))
    return df.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_arrow(stream: DataFrame, path: str, checkpoint: str, stats: str = "", **options) -> StreamingQuery:
    """Appends a stream to Arrow files with statistics."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.format("arrow_files").options(**options).option("path", f"{path}/{epoch:010d}").option("stats", stats).mode("append").save()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts_column: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in event-time windows with a watermark for late rows."""
    return stream.withWatermark(ts_column, late).groupBy(F.window(ts_column, width, slide), *by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts_column: str, gap: str, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in sessions: rows of a key that follow each other within the gap."""
    return stream.withWatermark(ts_column, late).groupBy(F.session_window(ts_column, gap), *by).agg(F.count("*").alias("n"))


def complete_to(stream: DataFrame, folder: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes the whole result of every micro-batch to a folder; the last one stays."""

    def replace(batch: DataFrame, epoch: int) -> None:
        change(batch).write.mode("overwrite").parquet(folder)

    return stream.writeStream.outputMode("complete").foreachBatch(replace).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()

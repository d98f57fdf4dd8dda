"""Incremental tables from streams of changes, and windows over event time."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with changed rows in place of their old ones; a change whose `deleted` is true takes its row out.

    Of several changes of a key the latest `ts` counts.
    """
    columns = [c for c in current.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct("deleted", *columns), "ts").alias("c"))
    kept = current.join(last.select(key), key, "left_anti")
    return kept.select(*current.columns).unionByName(last.filter("not coalesce(c.deleted, false)").select(key, *[F.col(f"c.`{c}`").alias(c) for c in columns]).select(*current.columns))


def change_ratio(current: DataFrame, changes: DataFrame, key: str) -> float:
    """Share of current rows that changes touch: an incremental build above a limit is better made anew."""
    n = current.count()
    return changes.select(key).distinct().join(current.select(key), key, "left_semi").count() / n if n else 1.0


class TableSink:
    """A table kept up to date by micro-batches: each writes a new version and then points to it, so that a batch that is run again does no harm."""

    def __init__(self, spark: SparkSession, root: str, key: str, empty: DataFrame):
        self.spark, self.root, self.key, self.schema = spark, root, key, empty.schema

    def _pointer(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "current"))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        path, fs = self._pointer()
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(os.path.join(self.root, f"v{v}"))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch, for foreachBatch."""
        v = self.version()
        if v is not None and epoch <= v:
            return
        upsert(self.read(), batch, self.key).write.mode("overwrite").parquet(os.path.join(self.root, f"v{epoch}"))
        path, fs = self._pointer()
        fs.mkdirs(path)
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, str(epoch)), True).close()


def event_windows(events: DataFrame, size: str, watermark: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; with a watermark also over a stream, where late rows are dropped."""
    e = events.withWatermark("ts", watermark) if watermark else events
    w = e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, session_start, session_end, n) of runs of events with less than a gap between them."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")

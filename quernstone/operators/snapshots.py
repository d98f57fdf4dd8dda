"""Snapshots of tables: created, frozen, tagged, found again by reference, pruned."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

REGISTRY = "id string, seq long, frozen boolean, tags array<string>, path string"


class Snapshots:
    """A folder of snapshots with a registry beside them. Versions of the registry are numbered; the last that is complete counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        p, fs = self._fs(os.path.join(self.root, "registry"))
        if not fs.exists(p):
            return -1
        done = []
        for s in fs.listStatus(p):
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                done.append(int(s.getPath().getName()))
        return max(done, default=-1)

    def registry(self) -> DataFrame:
        v = self._version()
        return self.spark.createDataFrame([], REGISTRY) if v < 0 else self.spark.read.schema(REGISTRY).parquet(os.path.join(self.root, "registry", str(v)))

    def _write(self, registry: DataFrame) -> None:
        registry.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.root, "registry", str(self._version() + 1)))

    def create(self, df: DataFrame, name: str) -> str:
        """Points a new snapshot at df, written once; returns its id."""
        last = self.registry().agg(F.max("seq")).first()[0]
        seq = 0 if last is None else last + 1
        id_, path = f"snap-{seq:06d}-{name}", os.path.join(self.root, "data", f"{seq:06d}")
        df.write.mode("overwrite").parquet(path)
        self._write(self.registry().unionByName(self.spark.createDataFrame([(id_, seq, False, [], path)], REGISTRY)))
        return id_

    def freeze(self, id_: str) -> None:
        self._write(self.registry().withColumn("frozen", F.col("frozen") | (F.col("id") == id_)))

    def tag(self, id_: str, tag: str) -> None:
        """Gives a tag to a snapshot, and takes it from any other."""
        rest = F.array_remove("tags", tag)
        self._write(self.registry().withColumn("tags", F.when(F.col("id") == id_, F.array_append(rest, tag)).otherwise(rest)))

    def prune(self, keep: int) -> list[str]:
        """Leaves out all but the last `keep` snapshots, except frozen and tagged ones; returns the ids left out."""
        rows = [(r.id, r.seq) for r in self.registry().filter("not frozen and size(tags) = 0").orderBy(F.desc("seq")).select("id", "seq").collect()]
        gone = [i for i, _ in rows[keep:]]
        if gone:
            self._write(self.registry().filter(~F.col("id").isin(gone)))
        return gone

    def resolve(self, ref: str) -> str:
        """The path of `latest`, `snap:<id>`, `tag:<name>`, `build:<seq>` or `path:<folder>`."""
        kind, _, value = ref.partition(":")
        if kind == "path" and value:
            return value
        r = self.registry()
        found = {
            "latest": lambda: r.orderBy(F.desc("seq")), "snap": lambda: r.filter(F.col("id") == value),
            "tag": lambda: r.filter(F.array_contains("tags", value)), "build": lambda: r.filter(F.col("seq") == int(value) if re.fullmatch(r"\d+", value) else F.lit(False)),
        }.get(kind)
        row = found().select("path").first() if found else None
        if row is None:
            raise KeyError(ref)
        return row.path

    def read(self, ref: str) -> DataFrame:
        return self.spark.read.parquet(self.resolve(ref))

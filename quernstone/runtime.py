"""Session helpers: table access, shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of a cluster, once in an application.

    Local workers find it on PYTHONPATH or in the working folder; elsewhere, and where they would not, Spark hands a zip of
    the sources to every executor, those that join later included.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    found = os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quernstone-"), "quernstone.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset in a session of one machine (tests), a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quernstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


_stored: dict[tuple, tuple] = {}


def _state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Size and time of the tables an artifact is made from: what tells that it is out of date."""
    out = []
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{n}.parquet"))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(path) if fs.exists(path) else None
        out.append((n, status.getLen(), status.getModificationTime()) if status else (n, -1, -1))
    return tuple(out)


def stored(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame] | None = None, by: str | None = None) -> DataFrame:
    """A table that several queries of an application read, made by the first of them and kept in the shared folder.

    It is made again when one of its source tables has another size or time. `write` lays the rows out before they are written; `by` is a column to partition by.
    """
    ship(spark)
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir, name, _state(spark, sf_dir, sources))
    if key not in _stored:
        target = os.path.join(shared_dir(spark), f"index-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}-{name}")
        df = build()
        out = (write(df) if write else df).write.mode("errorifexists")
        (out.partitionBy(by) if by else out).parquet(target)
        _stored[key] = target, df.schema
    target, schema = _stored[key]
    return spark.read.schema(schema).parquet(target)  # as it was written: columns to partition by are not guessed again


def one(df: DataFrame) -> Column:
    """The only row of df as a struct Column, by a scalar subquery; null where df is empty."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of each key with the greatest `order`.

    Only keys that occur more than once are compared, so the wide columns of df are not sorted; they are
    moved once at most, by the key, and not at all where the repeated keys are few enough for Spark to broadcast.
    Rows that agree in key and order all stay: callers drop exact repeats where they matter. A null order is the oldest.
    Rows with a null in the key name nothing: they all stay.
    """
    again = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__n"), F.max(order).alias("__last"))
        .filter("__n > 1")
        .select(*[F.col(k).alias(f"__{k}") for k in key], "__last")
    )
    on = [df[k] == again[f"__{k}"] for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = df.join(again, cond, "left")
    # a null __last means the key occurs once, or never has an order
    return joined.filter(F.col("__last").isNull() | (F.col(order) == F.col("__last"))).select(*[df[c] for c in df.columns])

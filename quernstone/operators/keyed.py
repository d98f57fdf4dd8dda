"""Ranks and tops within keys that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.runtime import cut

SALTS = 32


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = SALTS) -> DataFrame:
    """The first n rows of each key in an order: first within salted parts of a key, then among what these keep."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(salts)))
    part = salted.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))).filter(F.col("__n") <= n)
    return part.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n", "__salt")


def spread_rank(df: DataFrame, keys: list[str], order: str, name: str = "rank") -> DataFrame:
    """df with a rank from 1 within keys by one column that tells all rows of a key apart."""
    return ordered_rank(df, keys, [F.col(order).asc()], name)


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with a rank from 1 within keys, by an order of its own that tells all rows of a key apart.

    Rows are laid out by ranges of keys and order, so that a key with many rows lies in several partitions; each is ranked on its own and shifted by the
    sizes of those before it.
    """
    laid = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id()))
    local = laid.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    side = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), "__before")
    on = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return local.join(side, on).withColumn(name, (F.col("__n") + F.col("__before")).cast("int")).select(*df.columns, name)

"""Differences of two states of files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quernstone.operators.keyed import spread_rank, top_n


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, path, path_before) of added, removed, modified and renamed files.

    Both sides: path, hash, size. A file whose hash or size differs is modified; a size of 0 counts as none. Removed and added
    files of one hash are renames, paired by rank. Copies of a hash are ranked in parts, however many they are.
    """
    b = before.select("path", F.col("hash").alias("b_hash"), F.when(F.col("size") != 0, F.col("size")).alias("b_size"), F.lit(True).alias("b"))
    a = after.select("path", F.col("hash").alias("a_hash"), F.when(F.col("size") != 0, F.col("size")).alias("a_size"), F.lit(True).alias("a"))
    j = b.join(a, "path", "full")
    changed = ~F.col("b_hash").eqNullSafe(F.col("a_hash")) | ~F.col("b_size").eqNullSafe(F.col("a_size"))
    modified = j.filter("a and b").filter(changed).select(F.lit("modified").alias("kind"), "path", F.col("path").alias("path_before"))
    removed = spread_rank(j.filter("a is null").select("path", F.col("b_hash").alias("hash")), ["hash"], "path", "rn")
    added = spread_rank(j.filter("b is null").select("path", F.col("a_hash").alias("hash")), ["hash"], "path", "rn")
    pairs = removed.withColumnRenamed("path", "path_before").join(added, ["hash", "rn"], "full")
    kind = F.when(F.col("path").isNull(), "removed").when(F.col("path_before").isNull(), "added").otherwise("renamed")
    return modified.unionByName(pairs.select(kind.alias("kind"), F.coalesce("path", "path_before").alias("path"), "path_before"))


def chunk_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, chunk_id, logical): chunk events.

    Both sides: uid, chunk_id, logical, start, end, hash. Chunks are paired by chunk_id and rank, those left over by their logical key (what they
    are called, and where) and rank. A pair of another hash is modified, of another range only moved.
    """
    def ranked(df, key):
        return spread_rank(df, [key], "uid", "rn")

    b1, a1 = ranked(before, "chunk_id"), ranked(after, "chunk_id")
    first = b1.select("chunk_id", "rn", *[F.col(c).alias(f"b_{c}") for c in ("uid", "logical", "start", "end", "hash")]).join(
        a1.select("chunk_id", "rn", *[F.col(c).alias(f"a_{c}") for c in ("uid", "logical", "start", "end", "hash")]), ["chunk_id", "rn"])
    b2 = ranked(before.join(first.select(F.col("b_uid").alias("uid")), "uid", "left_anti"), "logical")
    a2 = ranked(after.join(first.select(F.col("a_uid").alias("uid")), "uid", "left_anti"), "logical")
    second = b2.select("logical", "rn", *[F.col(c).alias(f"b_{c}") for c in ("uid", "chunk_id", "start", "end", "hash")]).join(
        a2.select("logical", "rn", *[F.col(c).alias(f"a_{c}") for c in ("uid", "chunk_id", "start", "end", "hash")]), ["logical", "rn"], "full")
    kind = F.when(F.col("b_uid").isNull(), "added").when(F.col("a_uid").isNull(), "removed").when(F.col("b_hash") != F.col("a_hash"), "modified").when(
        (F.col("b_start") != F.col("a_start")) | (F.col("b_end") != F.col("a_end")), "moved").otherwise("same")
    one = first.select(kind.alias("kind"), "chunk_id", F.col("a_logical").alias("logical"))
    two = second.select(kind.alias("kind"), F.coalesce("a_chunk_id", "b_chunk_id").alias("chunk_id"), "logical")
    return one.unionByName(two).filter("kind != 'same'")


def summary(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def bounded(events: DataFrame, group: str, order: list[str], most: int, most_bytes: int) -> DataFrame:
    """The first events of each group until a number or a sum of bytes is reached; an event that would pass it is left out."""
    events = top_n(events, [group], [F.col(c) for c in order], most)  # in parts of a group first: no task holds more of one than it may keep
    w = Window.partitionBy(group).orderBy(*order)
    total = F.sum(F.length(F.to_json(F.struct(*[c for c in events.columns])))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("__n", F.row_number().over(w)).withColumn("__b", total).filter((F.col("__n") <= most) & (F.col("__b") <= most_bytes)).drop("__n", "__b")


def manifest_plan(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, action): what an incremental build does with each file: add, update, remove or keep, by hash, time and size."""
    j = stored.select("path", F.struct("hash", "mtime", "size").alias("s")).join(found.select("path", F.struct("hash", "mtime", "size").alias("f")), "path", "full")
    same = F.when(F.col("s.hash").isNotNull() & F.col("f.hash").isNotNull(), F.col("s.hash") == F.col("f.hash")).otherwise(
        F.col("s.mtime").eqNullSafe(F.col("f.mtime")) & F.col("s.size").eqNullSafe(F.col("f.size")))
    return j.select("path", F.when(F.col("s").isNull(), "add").when(F.col("f").isNull(), "remove").when(same, "keep").otherwise("update").alias("action"))

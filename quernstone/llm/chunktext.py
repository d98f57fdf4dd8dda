"""Chunks brought together with the text of their files, in bounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.operators.tables import with_file_id
from quernstone.runtime import latest

__all__ = ["files_with_chunks", "with_file_id"]

BATCH = 512  # chunks of one file that one row may carry; a file with more has several rows


def files_with_chunks(chunks: DataFrame, files: DataFrame, ref: Column) -> DataFrame:
    """(file_id, path, content, refs): the latest text of each file with `ref` of its chunks.

    chunks: file_id, id and what ref needs. A row carries about BATCH refs at most: a file that many chunks name comes in several
    rows, its chunks spread by a hash of their id. A file delivered again in the same state comes twice, so results
    must be made distinct. Files without chunks, and null contents, are left out.
    """
    crowded = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > BATCH)
    batch = F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / BATCH)))
    grouped = (
        chunks.join(crowded, "file_id", "left").select("file_id", batch.alias("__batch"), ref.alias("__ref"))
        .groupBy("file_id", "__batch").agg(F.collect_set("__ref").alias("refs"))
    )
    texts = latest(files.filter("file_id is not null and content is not null").select("file_id", "path", "content", "ingested_at"), ["file_id"], "ingested_at")
    return texts.select("file_id", "path", "content").join(grouped, "file_id").select("file_id", "path", "content", "refs")

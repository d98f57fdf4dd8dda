"""Frequency of every token and n-gram, with heavy terms counted in place.

Counts of partitions add up exactly once each occurrence of a term in a chunk is there once. Chunks that come once keep their n-grams where they are: only their ids move,
to tell which come again. Postings must meet their chunk; they move packed, as one array for a chunk and a range of tokens, not as rows.
Heavy terms, found by a Misra-Gries pass over all rows, are counted in local arrays and leave a task as one row each; only
the remaining terms are shuffled, after partial aggregation. Both count tables meet in one sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.runtime import cut, table

SUPPORT = 0.002  # a term in more than this share of the rows is heavy; at most 1 / SUPPORT terms are broadcast
RARE = 2  # terms in at most so many chunks are too rare
COMMON = 0.2  # terms in more than this share of a mode's chunks are too common
SEP = "\x1f"
PACK = 1 << 16  # tokens of a range: what one packed array of postings can hold is bounded by it
AGAIN = 1_000_000  # ids of chunks that come again, or are no more, up to which they are broadcast; more are met by a shuffle join
LOCAL = 256  # n-grams of a chunk whose repeats are told in place; longer lists go the way of chunks that come again


def ngram_text(gram: Column) -> Column:
    """An n-gram with single spaces between its words, whatever joined them."""
    return F.trim(F.regexp_replace(gram, r"[\x01_\s]+", " "))


def _key(mode: Column, kind: str, term: Column) -> Column:
    return F.concat(mode, F.lit(SEP + kind + SEP), term)


def heavy_terms(rows: DataFrame, support: float = SUPPORT) -> list[str]:
    """Keys that may hold more than `support` of the rows: all that do, and at most 1 / support in all."""
    found = rows.freqItems(["key"], support).first()
    return [k for k in (found[0] if found and found[0] else []) if k is not None]


def count_terms(rows: DataFrame, heavy: list[str]) -> DataFrame:
    """(key, total, chunks) from rows (key, occurrences) that hold each (chunk, key) once."""
    bound = rows.sparkSession.sparkContext.broadcast(heavy)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        names = bound.value
        totals, chunks = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        known = pa.array(names, pa.string())
        for batch in batches:
            at = pc.index_in(batch.column(0), value_set=known)
            light = batch.filter(pc.is_null(at))
            if light.num_rows:
                yield pa.RecordBatch.from_arrays([light.column(0), light.column(1), pa.array(np.ones(light.num_rows, np.int64))], ["key", "total", "chunks"])
            if light.num_rows < batch.num_rows:
                mask = pc.is_valid(at)
                slots = at.filter(mask).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(totals, slots, batch.column(1).filter(mask).to_numpy(zero_copy_only=False))
                chunks += np.bincount(slots, minlength=len(names))
        used = np.flatnonzero(chunks)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in used], pa.string()), pa.array(totals[used]), pa.array(chunks[used])], ["key", "total", "chunks"])

    counted = rows.select("key", "occurrences").mapInArrow(local, "key string, total bigint, chunks bigint")
    return counted.groupBy("key").agg(F.sum("total").alias("total"), F.sum("chunks").alias("chunks"))


def _token_rows(live: DataFrame, chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, occurrences) of each token in each chunk that exists, once."""
    # ids of tokens that differ in case only, with the least id among them: few rows
    spellings = (
        vocab.groupBy("mode", "token").agg(F.min("token_id").alias("term_id"), F.collect_set("token_id").alias("ids"))
        .filter(F.size("ids") > 1).select("mode", "term_id", F.explode("ids").alias("token_id"))
    )
    # chunks that are no more are told by ids alone, so that postings need no second move to meet those that are
    gone = cut(live.select("doc_id").distinct().join(chunks.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"))
    packed = live.groupBy("doc_id", "mode", F.floor(F.col("token_id") / PACK).alias("range")).agg(
        F.collect_set(F.shiftleft(F.pmod("token_id", F.lit(PACK)).cast("long"), 32) + F.col("tf").cast("long")).alias("codes"))
    there = packed.join(F.broadcast(gone) if gone.count() <= AGAIN else gone, "doc_id", "left_anti")
    code = F.col("code")
    once = there.select("doc_id", "mode", "range", F.explode("codes").alias("code")).select(
        "doc_id", "mode", "range", (F.col("range") * PACK + F.shiftright(code, 32)).alias("token_id"), code.bitwiseAND((1 << 32) - 1).alias("tf"))
    named = once.join(spellings, ["mode", "token_id"], "left")
    key = lambda term: _key(F.col("mode"), "token", F.col(term).cast("string")).alias("key")
    # tokens of one spelling are summed where they lie; only those of several meet across ranges
    alone = named.filter("term_id is null").groupBy("doc_id", "mode", "range", "token_id").agg(F.sum("tf").alias("n")).select(key("token_id"), F.col("n").cast("long").alias("occurrences"))
    shared = named.filter("term_id is not null").groupBy("doc_id", "mode", "term_id").agg(F.sum("tf").alias("n")).select(key("term_id"), F.col("n").cast("long").alias("occurrences"))
    return alone.unionAll(shared)


def _ngram_rows(chunks: DataFrame) -> DataFrame:
    """(key, occurrences) of each n-gram in each chunk, once."""
    listed = chunks.filter("mode is not null and ngrams is not null").select(
        "id", "mode", F.filter(F.transform("ngrams", ngram_text), lambda g: F.coalesce(g != "", F.lit(False))).alias("grams"))
    again = cut(chunks.groupBy("id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("id").alias("__id")))
    marked = listed.join(F.broadcast(again) if again.count() <= AGAIN else again, F.col("id") == F.col("__id"), "left")
    apart = F.col("__id").isNotNull() | (F.size("grams") > LOCAL)
    single = marked.filter(~apart).select("mode", F.explode(F.transform(F.array_distinct("grams"), lambda g: F.struct(g.alias("g"), F.size(F.filter("grams", lambda x: x == g)).cast("long").alias("n")))).alias("o"))
    rest = marked.filter(apart).select("id", "mode", "grams").distinct().select("id", "mode", F.explode("grams").alias("g")).groupBy("id", "mode", "g").agg(F.count(F.lit(1)).alias("n"))
    return single.select(_key(F.col("mode"), "ngram", F.col("o.g")).alias("key"), F.col("o.n").alias("occurrences")).unionAll(
        rest.select(_key(F.col("mode"), "ngram", F.col("g")).alias("key"), F.col("n").alias("occurrences")))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, kind, term, total, chunks, rare, common) of every token and n-gram that has a chunk.

    token: lower-case token; ids whose tokens differ in case only are one term; a posting counts if its tf is above 0 and
    its chunk exists; total sums tf over the chunks. ngram: single spaces between its words; total counts its repeats in a
    chunk. Rows delivered again count once. Null ids, modes, tokens and n-grams and blank n-grams are left out.
    """
    chunks, vocab, postings = (table(spark, sf_dir, t) for t in ("chunks", "token_vocab", "token_postings"))
    chunks = chunks.select("id", "mode", "ngrams").filter("id is not null")
    vocab = vocab.select("mode", "token_id", F.lower("token").alias("token")).filter("mode is not null and token_id is not null and token is not null")
    live = postings.filter("tf > 0 and mode is not null and token_id is not null and doc_id is not null").select("mode", "token_id", "doc_id", "tf")

    raw = live.select(_key(F.col("mode"), "token", F.col("token_id").cast("string")).alias("key")).unionAll(
        chunks.filter("mode is not null").select("mode", F.explode("ngrams").alias("g")).select(_key(F.col("mode"), "ngram", ngram_text(F.col("g"))).alias("key"))
    )
    heavy = heavy_terms(raw)
    counts = count_terms(_token_rows(live, chunks, vocab).unionAll(_ngram_rows(chunks)), heavy)
    part = F.split("key", SEP, 3)
    names = vocab.groupBy("mode", "token").agg(F.min("token_id").alias("term_id")).select(
        _key(F.col("mode"), "token", F.col("term_id").cast("string")).alias("key"), "token")
    # one join names the tokens and leaves n-grams, whose key is their text, as they are: the counts are made once
    named = (
        counts.join(names, "key", "left")
        .select(part[0].alias("mode"), part[1].alias("kind"), F.when(part[1] == "ngram", part[2]).otherwise(F.col("token")).alias("term"), "total", "chunks")
        .filter("term is not null")
    )
    sizes = chunks.groupBy("mode").agg(F.count_distinct("id").alias("mode_chunks"))
    return named.join(sizes, "mode").select(
        "mode", "kind", "term", "total", "chunks", (F.col("chunks") <= RARE).alias("rare"), (F.col("chunks") > COMMON * F.col("mode_chunks")).alias("common"))


def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, kind, term, mark): a row for each mark of a term."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return term_frequencies(spark, sf_dir).select("mode", "kind", "term", F.explode(marks).alias("mark"))

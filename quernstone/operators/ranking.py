"""Scores of chunks for a query: BM25 plain and by field, fusion, boosts, top-k."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.runtime import one

# Weights of the fields by query intent, and of full-text columns by profile.
FIELD_WEIGHTS = {
    "code": {"name": 2.0, "signature": 1.5, "doc": 1.2, "comment": 0.6, "body": 1.0, "keyword": 0.25, "operator": 0.05},
    "prose": {"name": 1.2, "signature": 0.9, "doc": 2.1, "comment": 1.8, "body": 1.7, "keyword": 0.2, "operator": 0.05},
    "path": {"name": 2.4, "signature": 1.7, "doc": 0.9, "comment": 0.4, "body": 0.7, "keyword": 0.2, "operator": 0.05},
    "url": {"name": 1.1, "signature": 0.8, "doc": 2.0, "comment": 1.8, "body": 1.7, "keyword": 0.2, "operator": 0.05},
    "mixed": {"name": 1.8, "signature": 1.3, "doc": 1.6, "comment": 1.2, "body": 1.2, "keyword": 0.25, "operator": 0.05},
}
FTS_WEIGHTS = {
    "balanced": {"file": 0.2, "name": 1.5, "signature": 1.2, "kind": 0.6, "headline": 1.5, "doc": 1.8, "tokens": 1.0},
    "headline": {"file": 0.1, "name": 1.2, "signature": 1.0, "kind": 0.4, "headline": 3.0, "doc": 2.2, "tokens": 1.0},
    "name": {"file": 0.2, "name": 2.5, "signature": 1.6, "kind": 0.8, "headline": 1.2, "doc": 1.4, "tokens": 1.0},
}


def tuned(average_length: float) -> tuple[float, float]:
    """k1 and b for an index by its average document length."""
    return (1.2, 0.6) if average_length > 800 else (1.7, 0.8)


def weight_of(weight: Column) -> Column:
    """A chunk's weight; missing and 0 count as 1."""
    return F.when(weight.isNull() | (weight == 0) | F.isnan(weight), 1.0).otherwise(weight)


def bm25(postings: DataFrame, lengths: DataFrame, stats: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75, field: str | None = None) -> DataFrame:
    """(doc_id, score) of the documents that hold a query token.

    postings: token, doc_id, tf; lengths: doc_id, dl; stats: one row with n (documents, empty ones too) and avg_dl. A
    field column in all three keeps statistics apart. df comes from all postings; a token named twice counts twice. The
    postings are cut to the query's tokens before anything moves.
    """
    times = Counter(query)
    keys = [field] if field else []
    hits = postings.filter(F.col("token").isin(sorted(times)))
    df = hits.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))
    qtf = F.lit(0)
    for t, n in sorted(times.items()):
        qtf = F.when(F.col("token") == t, F.lit(n)).otherwise(qtf)
    scored = hits.join(df, [*keys, "token"]).join(lengths, [*keys, "doc_id"])
    if keys:
        scored = scored.join(stats, keys)
    else:
        s = one(stats)
        scored = scored.withColumns({"n": s["n"], "avg_dl": s["avg_dl"]})
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl"))) * qtf
    return scored.groupBy(*keys, "doc_id").agg(F.sum(part).alias("score"))


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "doc_id", within: list[str] | None = None) -> DataFrame:
    """The k best rows, overall or within groups: score falling, then key rising; NaN scores are left out."""
    df = df.filter(F.col(score).isNotNull() & ~F.isnan(score))
    if not within:
        return df.orderBy(F.desc(score), F.asc(key)).limit(k)
    w = Window.partitionBy(*within).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k).drop("__rank")


def ranked(df: DataFrame, score: str = "score", key: str = "doc_id") -> DataFrame:
    """df with `rank` from 1. One window over all rows: for hit lists, whose length is bounded by their top-k."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def fuse_rrf(sparse: DataFrame, dense: DataFrame, k: int = 60) -> DataFrame:
    """(doc_id, score): sum of 1 / (k + rank) over two hit lists."""
    a = ranked(sparse).select("doc_id", F.col("rank").alias("a"))
    d = ranked(dense).select("doc_id", F.col("rank").alias("d"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return a.join(d, "doc_id", "full").select("doc_id", (part("a") + part("d")).alias("score"))


def fuse_blend(sparse: DataFrame, dense: DataFrame, sparse_weight: float = 0.7, dense_weight: float = 0.3) -> DataFrame:
    """(doc_id, score): sparse over its maximum and dense from [-1, 1] to [0, 1], by weights over the lists a hit is in."""
    s = sparse.withColumn("most", sparse.agg(F.max("score")).scalar()).select("doc_id", F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0).alias("s"))
    d = dense.select("doc_id", ((F.greatest(F.least(F.col("score"), F.lit(1.0)), F.lit(-1.0)) + 1) / 2).alias("d"))
    both = s.join(d, "doc_id", "full")
    weights = F.when(F.col("s").isNotNull(), sparse_weight).otherwise(0.0) + F.when(F.col("d").isNotNull(), dense_weight).otherwise(0.0)
    return both.select("doc_id", ((F.coalesce(F.col("s") * sparse_weight, F.lit(0.0)) + F.coalesce(F.col("d") * dense_weight, F.lit(0.0))) / weights).alias("score"))


def single_source(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(doc_id, score, source): the sparse score where there is one, else the dense one."""
    both = sparse.select("doc_id", F.col("score").alias("s")).join(dense.select("doc_id", F.col("score").alias("d")), "doc_id", "full")
    return both.select("doc_id", F.coalesce("s", "d").alias("score"), F.when(F.col("s").isNotNull(), "sparse").otherwise("dense").alias("source"))


def phrase_boost(matches: Column) -> Column:
    """Factor for phrase matches: a tenth each, a half at most."""
    return 1 + F.least(F.lit(0.5), 0.1 * matches)


def symbol_boost(kind: Column, exported: Column) -> Column:
    """Factor for definitions and exported symbols."""
    defines = F.lower(kind).rlike("function|class|method|interface|struct|enum|trait|func|fn|type")
    return F.when(F.coalesce(defines, F.lit(False)), 1.2).otherwise(1.0) * F.when(F.coalesce(exported, F.lit(False)), 1.1).otherwise(1.0)


def relation_boost(calls: Column, usages: Column, query: Column, per_call: float = 0.25, per_use: float = 0.1, most: float = 1.5) -> Column:
    """Addend for distinct query tokens among what a chunk calls and uses."""
    hit = lambda names: F.size(F.array_intersect(F.coalesce(names, F.array().cast("array<string>")), query))
    return F.least(F.lit(most), per_call * hit(calls) + per_use * hit(usages))


def explained(base: Column, phrase: Column, symbol: Column, relation: Column, weight: Column) -> Column:
    """struct of every part of a score, and `total`: base times weight and factors, plus what relations add."""
    return F.struct(base.alias("base"), weight.alias("weight"), phrase.alias("phrase"), symbol.alias("symbol"), relation.alias("relation"), (base * weight * phrase * symbol + relation).alias("total"))

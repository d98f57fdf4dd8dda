"""Quality of rankings, and reports over repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ranking_quality(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr, ndcg) of each query with expected items.

    hits: query_id, rank, item; expected: query_id, item. Recall counts expected items found within k; rr takes the best
    rank found at all; gain in nDCG is 0 or 1.
    """
    want = expected.distinct()
    totals = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    found = want.join(hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank")), ["query_id", "item"])
    per = found.groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("within"), F.min("rank").alias("best"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = totals.join(per, "query_id", "left")
    return j.select("query_id", (F.coalesce("within", F.lit(0)) / F.col("total")).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def compared(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(query_id, overlap, mean_delta, spearman, same_first) of two rankings (query_id, item, score, rank), by their first n."""
    x = a.filter(F.col("rank") <= n).select("query_id", "item", F.col("score").alias("sa"), F.col("rank").alias("ra"))
    y = b.filter(F.col("rank") <= n).select("query_id", "item", F.col("score").alias("sb"), F.col("rank").alias("rb"))
    j = x.join(y, ["query_id", "item"], "full")
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    shared = j.filter(both)
    w = lambda c: Window.partitionBy("query_id").orderBy(c)
    ranked = shared.withColumn("da", F.row_number().over(w("ra"))).withColumn("db", F.row_number().over(w("rb")))
    rho = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.sum(F.pow(F.col("da") - F.col("db"), 2)).alias("d2"), F.avg(F.abs(F.col("sa") - F.col("sb"))).alias("mean_delta"))
    first = shared.filter("ra = 1 and rb = 1").select("query_id").distinct().withColumn("same", F.lit(True))
    q = j.select("query_id").distinct()
    m = F.coalesce("m", F.lit(0))
    return q.join(rho, "query_id", "left").join(first, "query_id", "left").select(
        "query_id", (m / n).alias("overlap"), "mean_delta", F.when(m > 1, 1 - 6 * F.col("d2") / (m * (m * m - 1))).alias("spearman"), F.coalesce("same", F.lit(False)).alias("same_first"))


def throughput(stages: DataFrame) -> DataFrame:
    """(stage, runs, mean_ms, p50_ms, p95_ms) of stage times; percentiles are of the sketch, exact for few runs."""
    p = lambda q: F.percentile_approx("ms", q, 10000)
    return stages.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.avg("ms").alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"))


def cohorts(repos: DataFrame) -> DataFrame:
    """(cohort, repos, priority, rank) of enabled repos: more repos first, then more priority, then the lesser key; no cohort last among equals."""
    b = repos.filter("enabled").groupBy("cohort").agg(F.count(F.lit(1)).alias("repos"), F.sum(F.coalesce("priority", F.lit(0))).alias("priority"))
    # one row a cohort: few
    return b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("repos"), F.desc("priority"), F.asc_nulls_last("cohort"))))


def selected_repos(repos: DataFrame, explicit: list[str], tags: list[str], globs: list[str]) -> DataFrame:
    """Repos named by alias or id, even when disabled, and enabled ones with any of the tags that match a glob; by priority, alias, id."""
    from quernstone.operators.graph import glob_pattern

    named = F.coalesce(F.col("repo").isin(explicit) | F.col("alias").isin(explicit), F.lit(False)) if explicit else F.lit(False)
    by_tag = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else F.lit(True)
    by_glob = F.lit(not globs)
    for g in globs:
        by_glob = by_glob | F.col("repo").rlike(glob_pattern(g))
    chosen = named | (F.coalesce("enabled", F.lit(False)) & F.coalesce(by_tag, F.lit(False)) & by_glob)
    return repos.filter(chosen).orderBy(F.desc("priority"), F.asc("alias"), F.asc("repo"))


def cohort_gate(repos: DataFrame, cohort: str | None = None, unsafe: bool = False) -> DataFrame:
    """(repo, cohort, kept, reason) of enabled repos: those of the cohort asked for, else of the first one, are kept, others left out; unsafe keeps all.

    A cohort that no enabled repo has is an error, as is a query over none.
    """
    on = repos.filter("enabled")
    if cohort is not None and on.filter(F.col("cohort") == cohort).isEmpty():
        raise ValueError(f"no enabled repository has the cohort {cohort}")
    wanted = F.lit(cohort) if cohort is not None else cohorts(repos).filter("rank = 1").select("cohort").scalar()
    kept = F.lit(True) if unsafe else F.col("cohort").eqNullSafe(wanted)
    return on.select("repo", "cohort", kept.alias("kept"), F.when(~kept, "cohort-excluded").alias("reason"))


def contracts(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol_id, calls, mismatches): observed calls of each symbol, and those whose number of arguments it does not take.

    symbols: symbol_id, required, most (null for no bound); calls: symbol_id, args.
    """
    j = symbols.join(calls, "symbol_id")
    bad = (F.col("args") < F.col("required")) | F.coalesce(F.col("args") > F.col("most"), F.lit(False))
    return j.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(bad.cast("int")).alias("mismatches"))


def checks(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(check, violations) of an index: unique ids, postings within chunks, positive tf, ranges in order."""
    name = lambda df, n: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("check"), "violations")
    twice = chunks.groupBy("id").count().filter("count > 1")
    dangling = postings.join(chunks.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    return name(twice, "duplicate_ids").unionByName(name(dangling, "dangling_postings")).unionByName(name(postings.filter("tf is null or tf <= 0"), "empty_postings")).unionByName(name(chunks.filter("`end` <= start"), "inverted_ranges"))

"""Sources mixed to target weights by balanced sampling (cube method).

Each source is used a whole number of times, plus a sample for the rest. The sample starts from equal fractional inclusion
probabilities, which are moved through the null space of the constraints (tokens and documents) until each is 0 or 1, but for
as many as there are constraints: first within blocks of documents, then among what the blocks leave over, until one
landing problem of a handful of documents remains in each source.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.runtime import cut, latest, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"  # a file of the tokenizers library; a parameter everywhere
BLOCK = 4096  # documents in one flight; what is left of all blocks goes to the next round
SEED = 7
EPS = 1e-9


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with `tokens`, the length of text in tokens of a public tokenizer, in place of text; null texts have 0."""
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"], "tokens bigint"])

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for batch in batches:
            sizes = []
            texts = [x or "" for x in batch.column(len(others)).to_pylist()]
            for i in range(0, len(texts), 256):
                sizes += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(others))], pa.array(sizes, pa.int64())], [*others, "tokens"])

    return docs.select(*others, "text").mapInArrow(count, schema)


@dataclass
class Plan:
    """What one source gives: its target share, how often each document is used for certain, and the probability of once more."""

    source: str
    share: float
    times: int
    extra: float
    documents: int
    tokens: int


def plan(available: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> list[Plan]:
    """Plans of the sources that have tokens.

    available: documents and tokens by source. targets: source, weight, most repeats. Weights are scaled so that those of
    sources with tokens add up to one. The total is the largest at which every source can reach its share within its
    repeats, or `total` if that is less.
    """
    used = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and available.get(s, (0, 0))[1] > 0]
    weight = sum(w for _, w, _ in used)
    if not used:
        return []
    most = min(r * available[s][1] * weight / w for s, w, r in used)
    size = most if total is None else min(most, total)
    plans = []
    for s, w, r in used:
        documents, tokens = available[s]
        rate = min(float(r), size * w / weight / tokens)
        times = int(rate + EPS)
        extra = rate - times
        plans.append(Plan(s, w / weight, times, extra if extra > EPS else 0.0, documents, tokens))
    return plans


def flight(prob: list[float], size: list[float], draws: list[float]) -> list[float]:
    """Moves probabilities to 0 or 1 with the sums of prob and of prob * size kept, until two at most lie between.

    The constraints are the sums of size and of one over the documents, weighted by their probability: with three documents
    in play, the null space is a line, along which one step, up or down by chance so that probabilities stay fair, ends at
    the first bound.
    """
    prob = list(prob)
    todo = [i for i, p in enumerate(prob) if EPS < p < 1 - EPS]
    todo.reverse()
    play = [todo.pop() for _ in range(min(3, len(todo)))]
    step = 0
    while len(play) == 3:
        a, b, c = play
        # orthogonal to (1, 1, 1) and to the sizes
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - prob[i]) / x if x > 0 else prob[i] / -x for i, x in zip(play, u) if x)
        down = min(prob[i] / x if x > 0 else (1 - prob[i]) / -x for i, x in zip(play, u) if x)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        rest = []
        for i, x in zip(play, u):
            p = prob[i] + move * x
            prob[i] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
            if 0 < prob[i] < 1:
                rest.append(i)
        play = rest
        while len(play) < 3 and todo:
            play.append(todo.pop())
    return prob


def landing(prob: list[float], size: list[float]) -> list[float]:
    """Sets the probabilities that are left, a few, to the whole numbers that keep the sum of sizes best, then the count."""
    open_ = [i for i, p in enumerate(prob) if 0 < p < 1]
    want, count = sum(prob[i] * size[i] for i in open_), sum(prob[i] for i in open_)
    best = min(
        range(1 << len(open_)),
        key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - want), abs(m.bit_count() - count), m),
    )
    prob = list(prob)
    for k, i in enumerate(open_):
        prob[i] = float(best >> k & 1)
    return prob


_FLOWN = "doc_id bigint, source string, tokens bigint, prob double"


def _round(df: DataFrame, last: bool) -> DataFrame:
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "doc_id"])
        prob = flight(group.prob.tolist(), group.tokens.astype(float).tolist(), group.draw.tolist())
        if last:
            prob = landing(prob, group.tokens.astype(float).tolist())
        return pd.DataFrame({"doc_id": group.doc_id, "source": group.source, "tokens": group.tokens, "prob": prob})

    return df.groupBy("source", "block").applyInPandas(fly, _FLOWN)


def _blocked(df: DataFrame, sizes: dict[str, int], level: int) -> DataFrame:
    """df with a block and a draw for each document; blocks hold BLOCK documents on average."""
    blocks = F.lit(1)
    for source, n in sizes.items():
        blocks = F.when(F.col("source") == source, F.lit(max(1, -(-n // BLOCK)))).otherwise(blocks)
    h = F.xxhash64("doc_id", F.lit(SEED + level))
    return df.withColumn("block", F.pmod(h, blocks)).withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1000 + level)), F.lit(1 << 40)) / F.lit(float(1 << 40)))


def balanced_sample(docs: DataFrame, plans: list[Plan]) -> DataFrame:
    """(doc_id, source, tokens, picked): picked 1 for a sample of each source that keeps the expected tokens and documents."""
    extra = {p.source: p.extra for p in plans if p.extra > 0}
    probability = F.lit(0.0)
    for source, p in extra.items():
        probability = F.when(F.col("source") == source, F.lit(p)).otherwise(probability)
    current = docs.select("doc_id", "source", "tokens", probability.alias("prob"))
    settled = current.filter("prob = 0")
    current = current.filter("prob > 0")
    sizes = {p.source: p.documents for p in plans if p.extra > 0}
    level = 0
    while sizes:
        last = max(sizes.values()) <= BLOCK
        current = cut(_round(_blocked(current, sizes, level), last))
        settled = settled.unionByName(current.filter("prob = 0 or prob = 1"))
        if last:
            break
        # at most two documents of each block are left
        current = current.filter("prob > 0 and prob < 1")
        sizes = {r[0]: r[1] for r in current.groupBy("source").count().collect()}
        level += 1
    return settled.select("doc_id", "source", "tokens", F.col("prob").cast("int").alias("picked"))


def source_name(column):
    return F.lower(F.trim(column))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[Plan]]:
    """(doc_id, source, tokens, copies) of every document in the mixture, and the plans it follows.

    documents: doc_id, text, source, ingested_at; of a document delivered again the latest counts, of equally late ones that
    of the least source. Sources are compared lower-case and trimmed; documents of no or another source, and those
    without tokens, are left out. targets: source, weight, max_repeats; a source named twice has the sum of its weights.
    """
    wanted = [
        (r[0], float(r[1]), int(r[2]))
        for r in targets.filter("source is not null and weight > 0 and max_repeats > 0").groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum("weight"), F.min("max_repeats")).orderBy("source").collect()
    ]
    base = latest(documents.filter("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text", "ingested_at"), ["doc_id"], "ingested_at")
    base = base.filter(F.col("source").isin([s for s, _, _ in wanted])).select("doc_id", "source", "text")
    sized = token_counts(base, tokenizer).filter("tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens")
    sized = cut(sized)
    available = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.count(F.lit(1)), F.sum("tokens")).collect()}
    plans = plan(available, wanted, total)
    times = F.lit(0)
    for p in plans:
        times = F.when(F.col("source") == p.source, F.lit(p.times)).otherwise(times)
    mixed = balanced_sample(sized, plans).select("doc_id", "source", "tokens", (times + F.col("picked")).alias("copies")).filter("copies > 0")
    return mixed, plans


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixtargets"))[0]


def mixed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, documents, copies, tokens, share): what each source gives to the mixture."""
    mixed, plans = mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixtargets"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total = got.agg(F.sum("tokens")).first()[0] or 1
    target = spark.createDataFrame([(p.source, p.share) for p in plans], "source string, target double")
    return target.join(got, "source", "left").select(
        "source", F.round("target", 6).alias("target"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0)), 6).alias("share"))

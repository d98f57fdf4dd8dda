"""Nearest neighbours of stated query rows, and MinHash signatures."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quernstone.runtime import cut

MINHASH_SLOTS = 128
SIGN_ROWS, MIN_ROWS = 512, 64  # rows that are signed at once, and rows whose hashes are
_M = 1 << 32
QUERY_BLOCK = 4096  # query vectors that are broadcast at once


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k rows of greatest dot product for each query row, ties to the lesser id; rows without a vector neither ask nor answer.

    Queries go out in blocks of QUERY_BLOCK rows; each task keeps its own k best a query, so that only these are shuffled.
    """
    queries = queries.filter(F.col(column).isNotNull())
    n = queries.count()
    out = None
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, column).collect()
        ids = [r[0] for r in rows]
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        if not ids:
            continue
        bound = vectors.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), matrix))

        def search(batches, bound=bound):
            q_ids, q = bound.value
            best_s = np.full((len(q_ids), 0), 0.0)
            best_i = np.full((len(q_ids), 0), 0, dtype=np.int64)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                if not len(ids):
                    continue
                s = np.concatenate([best_s, q @ x.T], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(ids, (len(q_ids), len(ids)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            if best_s.shape[1]:
                m = best_s.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, m)), pa.array(best_i.ravel()), pa.array(best_s.ravel())], ["query_id", "id", "score"])

        found = vectors.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(search, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


WORDS = 200_000  # words whose folds a task remembers


def minhash(df: DataFrame, key: str, tokens: str, slots: int = MINHASH_SLOTS, words: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(key, signature): minima over the distinct tokens of `slots` hashes; rows without tokens are left out. `tokens` is a text where `words` tells its tokens.

    The hash of slot k folds h * 31 + c over the characters from seed k, modulo 2^32. As the fold is linear in its seed, a token needs one
    fold for its constant part and one power of 31; the slots of all tokens are then one product of vectors. A token whose least hash is
    above the greatest hash of another token of its row is the minimum of no slot, so few tokens of a row come to that product.
    """
    kind = df.schema[key].dataType.simpleString()

    def sign(batches):
        seeds = np.arange(1, slots + 1, dtype=np.uint32)
        known: dict[str, int] = {}
        parts = np.zeros((0, 4), np.uint32)  # of each known word: its fold, power of 31, least and greatest hash

        def fold(token):
            h, p = 0, 1
            for c in token:
                h, p = (h * 31 + ord(c)) % _M, p * 31 % _M
            return h, p

        for batch in batches:
            for at in range(0, batch.num_rows, SIGN_ROWS):
                part = batch.slice(at, SIGN_ROWS)
                lists = [[] if t is None else words(t) if words else [w for w in t if w is not None] for t in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in lists])
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                flat = list(chain.from_iterable(lists))
                if len(known) > WORDS:
                    known, parts = {}, parts[:0]
                new = [w for w in set(flat) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                added = [parts]
                for n in range(0, len(new), SIGN_ROWS):
                    hp = np.array([fold(w) for w in new[n : n + SIGN_ROWS]], dtype=np.uint32)  # products of 32 bits are modulo 2^32
                    every = hp[:, 1:] * seeds + hp[:, :1]
                    added.append(np.column_stack([hp, every.min(axis=1), every.max(axis=1)]))
                parts = np.concatenate(added)
                mine = parts[np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))]
                starts = np.cumsum(sizes[full]) - sizes[full]
                keep = mine[:, 2] <= np.repeat(np.minimum.reduceat(mine[:, 3], starts), sizes[full])
                kept = np.add.reduceat(keep, starts, dtype=np.int64)
                ends = np.cumsum(kept)
                few = mine[keep]
                out = []
                for n in range(0, len(full), MIN_ROWS):  # the product is made for some rows at once
                    lo, hi = ends[n] - kept[n], ends[min(n + MIN_ROWS, len(full)) - 1]
                    out.append(np.minimum.reduceat(few[lo:hi, 1:2] * seeds + few[lo:hi, :1], (ends - kept)[n : n + MIN_ROWS] - lo, axis=0))
                flat_out = pa.ListArray.from_arrays(pa.array(np.arange(0, slots * len(full) + 1, slots, dtype=np.int32)), pa.array(np.concatenate(out).ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), flat_out], [key, "signature"])

    return df.select(key, tokens).mapInArrow(sign, f"`{key}` {kind}, signature array<bigint>")


LISTS, FIT_ROWS = 64, 20_000  # lists around centroids, and rows of the sample that centroids are fitted to


def centroids(vectors: DataFrame, lists: int = LISTS, rows: int = FIT_ROWS, column: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """Centres of vectors: a few rounds of k-means over a sample of at most `rows` rows, taken by the digests of their keys."""
    sample = vectors.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(key), key).limit(rows).collect()
    x = np.array([r[0] for r in sample], dtype=np.float64)
    if not len(x):
        return np.empty((0, 0))
    c = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(8):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for k in range(len(c)):
            mine = x[near == k]
            if len(mine):
                c[k] = mine.mean(axis=0)
    return c


def listed(vectors: DataFrame, c: np.ndarray, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, column, list, radius): every vector with the list of its nearest centroid and its distance to it: the index. Keep it laid out by list."""
    bound = vectors.sparkSession.sparkContext.broadcast(c)
    kind = vectors.schema[key].dataType.simpleString()

    def assign(batches):
        centres = bound.value
        norms = 0.5 * (centres * centres).sum(axis=1)
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            if len(x):
                near = (x @ centres.T - norms).argmax(axis=1)
                far = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(near.astype(np.int32)), pa.array(far)], [key, column, "list", "radius"])

    return vectors.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(assign, f"`{key}` {kind}, `{column}` array<double>, list int, radius double")


def pruned_nearest(index: DataFrame, c: np.ndarray, queries: DataFrame, k: int, probes: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): what `nearest` gives, exactly, without a look at lists that cannot hold a better row.

    No row of a list has a dot product with q above q.c + |q| * radius. A first pass over the lists of the greatest q.c gives each query a k-th score; the
    second goes through those lists alone whose bound reaches it. Queries are read in blocks of QUERY_BLOCK.
    """
    spark = index.sparkSession
    radii = {r[0]: r[1] for r in index.groupBy("list").agg(F.max("radius").alias("r")).collect()}  # one row a list
    out = None
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).filter(F.col(column).isNotNull()).select(key, column).collect()
        if not rows or not radii:
            continue
        ids, q = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)
        lists = np.array(sorted(radii))
        towards = q @ c[lists].T
        reach = towards + np.linalg.norm(q, axis=1)[:, None] * np.array([radii[n] for n in lists.tolist()])[None, :] + 1e-9
        first = np.argsort(-towards, axis=1, kind="stable")[:, :probes]
        asked = np.zeros_like(towards, dtype=bool)
        np.put_along_axis(asked, first, True, axis=1)
        near = _search_lists(index, ids, q, lists, asked, k, key, column)
        floor = {r[0]: r[1] for r in near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("s")).collect()}  # one row a query
        tau = np.array([floor.get(int(i)) if floor.get(int(i)) is not None else -np.inf for i in ids])
        more = (reach >= tau[:, None]) & ~asked
        found = near.unionByName(_search_lists(index, ids, q, lists, more, k, key, column))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search_lists(index: DataFrame, ids: np.ndarray, q: np.ndarray, lists: np.ndarray, asked: np.ndarray, k: int, key: str, column: str) -> DataFrame:
    """(query_id, id, score): the k best rows of each query among the lists it asks for. Lists that none asks for are not read."""
    wanted = [int(n) for n, any_ in zip(lists, asked.any(axis=0)) if any_]
    bound = index.sparkSession.sparkContext.broadcast((ids, q, {int(n): np.flatnonzero(asked[:, j]) for j, n in enumerate(lists)}))

    def search(batches):
        names, vectors, by_list = bound.value
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            rows = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            for n in np.unique(at):
                who = by_list[int(n)]
                if not len(who):
                    continue
                mine = at == n
                scores = vectors[who] @ x[mine].T
                for j, w in enumerate(who.tolist()):
                    order = np.lexsort((rows[mine], -scores[j]))[:k]
                    held = best.get(w, []) + list(zip((-scores[j][order]).tolist(), rows[mine][order].tolist()))
                    best[w] = sorted(held)[:k]
        cells = [(int(names[w]), i, -s) for w, held in best.items() for s, i in held]
        if cells:
            a, b, d = zip(*cells)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["query_id", "id", "score"])

    part = index.filter(F.col("list").isin(wanted)) if wanted else index.limit(0)
    found = part.select(key, column, "list").mapInArrow(search, "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return cut(found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n"))


MIN_SLOTS = 16  # slots that a shortened signature has at least


def sampling_plan(documents: int, most: int, slots: int = MINHASH_SLOTS, least: int = MIN_SLOTS) -> tuple[int, int]:
    """(stride, slots) of signatures when an index of at most `most` documents has more: each is shortened to every stride-th slot. (1, slots) where it has not."""
    if not most or documents <= most:
        return 1, slots
    stride = max(1, min(slots // min(least, slots), documents // most))
    return stride, max(min(least, slots), -(-slots // stride))


def shortened(signature: Column, stride: int, slots: int) -> Column:
    """Every stride-th slot of a signature, the first `slots` of them."""
    return F.slice(F.filter(signature, lambda _, i: i % stride == 0), 1, slots)


SLICE = 2048  # signatures of documents that are compared with a block of queries at once
CELLS = 1_000_000  # candidates that are put in order at once


def minhash_nearest(signatures: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k most alike documents of each query, by the share of equal slots; ties to the lesser id, none without an equal slot.

    queries: (doc_id, signature); a query is not compared with the document of its own id. Equal signatures are compared once, those of queries and those of the documents of
    a task: words of one letter have the least hashes, so many documents have one signature. Signatures of queries go out in blocks of QUERY_BLOCK; a task
    keeps the best of each, so that only these are shuffled: neither slots nor values that many documents share move.
    """
    docs = signatures.filter("doc_id is not null and signature is not null").select("doc_id", "signature", F.lit(1).alias("copies"))
    asked = cut(queries.filter("doc_id is not null and signature is not null").select("doc_id", "signature"))
    own = _most(docs, asked)
    if own > 1:  # rows of one id: equal ones become one with their number
        docs = cut(docs.groupBy("doc_id", "signature").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")))
        own = _most(docs, asked)
    most = k + own  # of these a query leaves out its own
    distinct = cut(asked.select("signature").distinct().withColumn("ask", F.monotonically_increasing_id()))
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = distinct.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == b).select("ask", "signature").collect()
        if not rows:
            continue
        q = np.array([r[1] for r in rows], dtype=np.int64)
        order = np.argsort(q, axis=0, kind="stable")
        bound = signatures.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.take_along_axis(q, order, 0), order))

        def search(batches, bound=bound):
            names, values, places = bound.value
            best = _Best(values, places, most, SLICE)
            slots, groups = values.shape[1], {}
            for batch in batches:
                ids, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
                width = 8 * slots
                for i, pair in enumerate(zip(ids, copies)):
                    group = groups.setdefault(raw[i * width : (i + 1) * width], [])
                    group.append(pair)
                    if len(group) >= 8 * most:
                        group.sort()
                        del group[most:]
                if len(groups) >= SLICE:
                    best.meet(groups)
                    groups = {}
            best.meet(groups)
            who, col = np.nonzero(best.score)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(best.ident[who, col]), pa.array(best.score[who, col] / slots), pa.array(best.copies[who, col])], ["ask", "doc_id", "score", "copies"])

        found = docs.mapInArrow(search, "ask bigint, doc_id bigint, score double, copies int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return signatures.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    first = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc("doc_id"))
    near = out.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).drop("n")
    who = asked.join(distinct, "signature").groupBy(F.col("doc_id").alias("query_id"), "ask").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    pairs = near.join(who, "ask").filter("doc_id != query_id").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.col("copies") * F.col("times"), F.lit(k)))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return pairs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("query_id", "doc_id", "score")


def _most(docs: DataFrame, asked: DataFrame) -> int:
    """Rows of the id of a query, at most. Only ids move."""
    return docs.select("doc_id").join(asked.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


class _Best:
    """The `most` best documents of each query signature among those met: equal slots (0: none), id and copies, the best first."""

    def __init__(self, values: np.ndarray, places: np.ndarray, most: int, width: int):
        """values: the signatures, sorted in each slot; places: whose they are; width: signatures of documents that meet them at once."""
        self.values, self.places, self.width = values, places, width
        n, slots = values.shape
        self.codes = np.empty((slots, n), np.int32)  # of each signature, the first place of its value in the sorted slot
        for s in range(slots):
            self.codes[s, places[:, s]] = np.searchsorted(values[:, s], values[:, s], "left")
        self.score, self.ident, self.copies = np.zeros((n, most), np.int32), np.zeros((n, most), np.int64), np.zeros((n, most), np.int32)

    def meet(self, groups: dict[bytes, list[tuple[int, int]]]) -> None:
        """groups: (id, copies) of the documents of each signature."""
        most, width = self.score.shape[1], self.width
        for group in groups.values():
            group.sort()
            del group[most:]
        by_id = sorted(groups.items(), key=lambda g: g[1][0])
        for at in range(0, len(by_id), width):
            part = by_id[at : at + width]
            equal = self._equal(np.frombuffer(b"".join(g[0] for g in part), np.int64).reshape(len(part), -1))
            wide = max(len(g[1]) for g in part)
            ids, copies = np.zeros((len(part), wide), np.int64), np.zeros((len(part), wide), np.int32)
            for i, (_, group) in enumerate(part):
                ids[i, : len(group)], copies[i, : len(group)] = zip(*group)
            live = np.flatnonzero((equal >= np.maximum(self.score[:, -1:], 1)).any(axis=1))
            take = min(most, len(part))  # a document of the best is of one of so many groups, by score and least id
            step = max(1, CELLS // max(take * wide, len(part)))
            for r in range(0, len(live), step):
                rows = live[r : r + step]
                rank = equal[rows].astype(np.int32) * width + np.arange(width - 1, width - 1 - len(part), -1, dtype=np.int32)
                rank = np.partition(rank, len(part) - take, axis=1)[:, len(part) - take :]
                j = width - 1 - rank % width
                many = copies[j].reshape(len(rows), -1)
                score = np.where(many > 0, np.repeat(rank // width, wide, axis=1), 0)
                held = [np.concatenate(x, axis=1) for x in ((self.score[rows], score), (self.ident[rows], ids[j].reshape(len(rows), -1)), (self.copies[rows], many))]
                first = np.lexsort((held[1], -held[0]), axis=1)[:, :most]
                self.score[rows], self.ident[rows], self.copies[rows] = (np.take_along_axis(x, first, 1) for x in held)

    def _equal(self, d: np.ndarray) -> np.ndarray:
        """Equal slots of each query signature and each row of d."""
        n, slots = self.values.shape
        equal = np.zeros((n, len(d)), np.min_scalar_type(slots))
        for s in range(slots):
            lo, hi = np.searchsorted(self.values[:, s], d[:, s], "left"), np.searchsorted(self.values[:, s], d[:, s], "right")
            count = hi - lo
            if count.sum() * 8 > equal.size:
                equal += self.codes[s][:, None] == np.where(count > 0, lo, -1).astype(np.int32)[None, :]
                continue
            of = np.repeat(np.arange(len(d)), count)
            slot = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            equal[self.places[slot, s], of] += 1
        return equal

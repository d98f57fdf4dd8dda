"""MinHash signatures and search: equal signatures, odd tables, texts."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import similarity as S


def test_minhash_search_meets_equal_signatures_once(spark, monkeypatch):
    """A million pairs of one signature are one pair of signatures: what is compared is counted, not timed."""
    rows = [(i, [i % 3, i % 2, 7, 7]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, signature array<long>").coalesce(1)
    seen = spark.sparkContext.accumulator(0)
    compare = S._Best._equal

    class Counted(S._Best):
        def _equal(self, d):
            seen.add(len(self.places) * len(d))
            return compare(self, d)

    monkeypatch.setattr(S, "_Best", Counted)
    got = {}
    for r in S.minhash_nearest(df, df.filter("doc_id % 2 = 0"), 3).collect():
        got.setdefault(r.query_id, set()).add((r.doc_id, r.score))
    assert got == {q: {(i, 1.0) for i in [x for x in range(q % 6, 40, 6) if x != q][:3]} for q in range(0, 2000, 2)}
    assert 0 < seen.value <= 3 * 6


@pytest.mark.parametrize("block, width", [(4096, 2048), (5, 7)])
def test_minhash_search_equals_brute_force_on_odd_tables(spark, monkeypatch, block, width):
    """Ids that come again with the same or another signature, null ids and signatures, slots that many share, signatures of their own."""
    rnd = random.Random(31)
    rows = [(i, [rnd.choice([3, 3, 3, rnd.randrange(40)]) for _ in range(8)]) for i in range(120)] + [(200 + i, [1000 + 8 * i + s for s in range(8)]) for i in range(60)]
    rows += [(20, rows[20][1])] * 5 + [(20, [3] * 8)] * 3 + [(40, rows[41][1]), (41, rows[40][1])] + [(None, [3] * 8), (240, None), (300, None)]
    df = spark.createDataFrame(rows, "doc_id long, signature array<long>").repartition(3)
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    monkeypatch.setattr(S, "SLICE", width)
    want = collections.Counter()
    for q in {i for i, s in rows if s and i is not None and i % 20 == 0}:
        pairs = sorted((-sum(a == b for a, b in zip(s, t)), i) for j, s in rows if j == q and s for i, t in rows if t and i is not None and i != q)
        want.update((q, i, -n / 8) for n, i in [p for p in pairs if p[0]][:4])
    assert collections.Counter((r.query_id, r.doc_id, r.score) for r in S.minhash_nearest(df, df.filter("doc_id % 20 = 0"), 4).collect()) == want


def test_minhash_of_texts_equals_minhash_of_their_words(spark, monkeypatch):
    monkeypatch.setattr(S, "SIGN_ROWS", 3)
    monkeypatch.setattr(S, "MIN_ROWS", 2)
    monkeypatch.setattr(S, "WORDS", 10)
    texts = ["parseHTTPReq_v2-x", "", None, " --", "Schpföß ÉtéA", "İstanbul K9", "longidentifierwithoutcapitals0123456789 anotherverylongidentifier", "a\x00b퟿c", "zz top aa", "ABC\tdef\nGhi"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    split = df.select("k", X.split_identifier(F.col("t")).alias("t"))
    assert [None if t is None else X.identifier_words(t) for t in texts] == [r.t for r in split.orderBy("k").collect()]
    want = {}
    for r in split.collect():
        for k in range(1, 129):
            for w in r.t or ():
                h = k
                for c in w:
                    h = (h * 31 + ord(c)) % 2**32
                want.setdefault(r.k, {}).setdefault(k, []).append(h)
    want = {i: [min(v[k]) for k in range(1, 129)] for i, v in want.items()}
    assert {r.k: r.signature for r in S.minhash(df, "k", "t", words=X.identifier_words).collect()} == want
    assert {r.k: r.signature for r in S.minhash(split, "k", "t").collect()} == want

import os
import random

import pytest

from quernstone.llm import mixing

TOKENIZER = mixing.TOKENIZER


def test_flight_keeps_both_sums():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 50, 2000):
        size = [float(rnd.choice([5, 5, rnd.randrange(1, 900)])) for _ in range(n)]
        prob = [0.37] * n
        out = mixing.flight(prob, size, [rnd.random() for _ in range(max(1, n))])
        assert sum(0 < p < 1 for p in out) <= 2 and all(0 <= p <= 1 for p in out)
        assert abs(sum(out) - sum(prob)) < 1e-6 and abs(sum(p * s for p, s in zip(out, size)) - sum(p * s for p, s in zip(prob, size))) < 1e-3
        done = mixing.landing(out, size)
        assert all(p in (0.0, 1.0) for p in done)


def test_plan_scales_weights_and_respects_repeats():
    plans = {p.source: p for p in mixing.plan({"a": (10, 1000), "b": (5, 100), "c": (3, 0)}, [("a", 0.5, 1), ("b", 0.4, 4), ("c", 0.3, 9), ("d", 0.1, 1)])}
    assert set(plans) == {"a", "b"} and abs(plans["a"].share - 0.5 / 0.9) < 1e-9
    assert plans["b"].times == 4 and plans["b"].extra == 0
    assert plans["a"].times == 0 and abs(plans["a"].extra - 0.5) < 1e-9
    assert mixing.plan({}, [("a", 1.0, 1)]) == []


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_mixture_reaches_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.randrange(1, 60), rnd.choice([" Wiki", "wiki"]), None) for i in range(900)]
    rows += [(1000 + i, "word " * rnd.randrange(1, 60), "CHAT", None) for i in range(200)] + [(5000 + i, "word", "spec", None) for i in range(30)]
    rows += [(7001, "", "wiki", None), (7002, None, "wiki", None), (7003, "x", None, None), (7004, "x", "else", None)] + rows[:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ingested_at timestamp")
    targets = spark.createDataFrame([("wiki", 0.5, 1), ("chat", 0.6, 2), ("none", 0.2, 3)], "source string, weight double, max_repeats int")
    mixed, plans = mixing.mixture(docs, targets)
    got = mixed.collect()
    assert len(got) == len({r.doc_id for r in got})
    size = {s: sum(r.tokens * r.copies for r in got if r.source == s) for s in ("wiki", "chat")}
    assert abs(size["wiki"] / (size["wiki"] + size["chat"]) - 0.5 / 1.1) < 0.01
    assert max(r.copies for r in got if r.source == "wiki") <= 1 and max(r.copies for r in got if r.source == "chat") <= 2
    none, _ = mixing.mixture(docs.limit(0), targets)
    assert none.count() == 0

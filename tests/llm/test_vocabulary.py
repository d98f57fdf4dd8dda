import random
from collections import Counter, defaultdict

from quernstone.llm import vocabulary
from tests.conftest import write_tables

CHUNKS = "id long, mode string, ngrams array<string>"
VOCAB = "mode string, token_id long, token string"
POSTINGS = "mode string, token_id long, doc_id long, tf int, repo string"


def brute(chunks, vocab, postings):
    modes, ids = defaultdict(set), set()
    for i, m, _ in chunks:
        if i is not None:
            modes[m].add(i)
            ids.add(i)
    names = {(m, t): w.lower() for m, t, w in vocab if w is not None}
    total, docs = Counter(), defaultdict(set)
    for m, t, d, tf in {p[:4] for p in postings}:
        if tf and tf > 0 and d in ids and (m, t) in names:
            total[m, "token", names[m, t]] += tf
            docs[m, "token", names[m, t]].add(d)
    for i, m, grams in {(i, m, tuple(g)) for i, m, g in chunks if g is not None}:
        for g in grams:
            term = " ".join(x for x in (g or "").replace("\x01", " ").replace("_", " ").split())
            if term and m is not None and i is not None:
                total[m, "ngram", term] += 1
                docs[m, "ngram", term].add(i)
    return {(*k, n, len(docs[k]), len(docs[k]) <= 2, len(docs[k]) > 0.2 * len(modes[k[0]])) for k, n in total.items()}


def test_equals_brute_force_with_heavy_terms(spark, tmp_path):
    rnd = random.Random(5)
    chunks = [(i, rnd.choice(["code", "prose"]), [rnd.choice(["a\x01b", "a_b", "b c", "", None, "d__e"]) for _ in range(rnd.randrange(6))] if rnd.random() < 0.9 else None) for i in range(300)]
    chunks += chunks[:40] + [(None, "code", ["x_y"]), (999, None, ["x_y"])]
    vocab = [(m, t, f"{'Tok' if t % 5 == 0 else 'tok'}{t // 2 * 2 if t % 5 == 0 else t}") for m in ("code", "prose") for t in range(60)] + [("code", 77, None)]
    postings = [(m, 0 if rnd.random() < 0.4 else rnd.randrange(62), rnd.randrange(330), rnd.randrange(4), "r") for m in ("code", "prose") for _ in range(900)]
    postings += postings[:200] + [("code", None, 3, 2, "r"), ("code", 3, None, 2, "r"), ("code", 3, 3, None, "r")]
    folder = write_tables(spark, tmp_path, chunks=(chunks, CHUNKS), token_vocab=(vocab, VOCAB), token_postings=(postings, POSTINGS))
    got = {tuple(r) for r in vocabulary.term_frequencies(spark, folder).collect()}
    assert got == brute(chunks, vocab, postings)


def test_heavy_terms_are_bounded_and_complete(spark):
    rows = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(500)], "key string")
    heavy = vocabulary.heavy_terms(rows, 0.1)
    assert "hot" in heavy and len(heavy) <= 11


def test_empty(spark, tmp_path):
    folder = write_tables(spark, tmp_path, chunks=([], CHUNKS), token_vocab=([], VOCAB), token_postings=([], POSTINGS))
    assert vocabulary.marked_terms(spark, folder).count() == 0

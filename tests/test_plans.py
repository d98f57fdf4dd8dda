import random

import pytest
from pyspark.sql import functions as F

from quernstone.plans import filters as P, query as Q


def test_precedence_and_negation():
    t = Q.parse('a or b c and -"d e"')
    assert t == Q.Or(Q.Term("a"), Q.And(Q.And(Q.Term("b"), Q.Term("c")), Q.Not(Q.Phrase("d e"))))
    assert Q.flatten(Q.parse("a not not b -c")).not_terms == ["c"]
    assert Q.parse("") is None and Q.parse("''") is None


def test_errors_and_fallback():
    with pytest.raises(Q.QueryError):
        Q.understand("a -")
    with pytest.raises(Q.QueryError):
        Q.understand("-(a b)")
    tree, flat, reason = Q.understand('a "b c')
    assert flat.terms == ["a", "b", "c"] and reason
    assert Q.understand("(a b")[1].terms == ["a", "b"]


def test_match_text_and_variants():
    assert Q.match_text(Q.parse('a -b ("c d" or e)')) == '("a") AND (("c d") OR ("e"))'
    assert Q.fts_variant("foo*")[0] == "trigram" and Q.fts_variant("日本")[1] == "cjk_or_emoji" and Q.fts_variant("run", frozenset(["stemming"]))[0] == "porter"
    assert Q.fts_variant("ﬁn") == ("unicode61", "default_unicode61+nfkc_normalized")


def evaluate(tree, tokens, grams):
    if isinstance(tree, Q.Not):
        return not evaluate(tree.child, tokens, grams)
    if isinstance(tree, Q.And):
        return evaluate(tree.left, tokens, grams) and evaluate(tree.right, tokens, grams)
    if isinstance(tree, Q.Or):
        return evaluate(tree.left, tokens, grams) or evaluate(tree.right, tokens, grams)
    parts = Q.tokens_of(tree.value)
    if isinstance(tree, Q.Phrase) and 2 <= len(parts) <= 4:
        return " ".join(parts) in grams
    return any(p in tokens for p in parts)


def test_conditions_equal_brute_force(spark):
    rnd = random.Random(4)
    docs = [(i, [rnd.choice("abcde") for _ in range(rnd.randrange(5))], [rnd.choice(["a b", "b c"]) for _ in range(2)]) for i in range(60)] + [(99, None, None)]
    df = spark.createDataFrame(docs, "id int, t array<string>, g array<string>").cache()
    for text in ("a", "a -b", '"a b" or (c and d)', "a or b or -c", '"b c d e a" e', "x", "not a"):
        tree = Q.parse(text)
        got = {r.id for r in df.filter(Q.condition(tree, F.col("t"), F.col("g"))).select("id").collect()}
        assert got == {i for i, t, g in docs if evaluate(tree, t or [], g or [])}, text


def test_intents(spark):
    rows = [("src/a/b.js", "path"), ("https://x.invalid/a", "url"), ("foo.bar(x) => y_z", "code"), ("where is the parser", "prose"), ("", "mixed"), (None, "mixed"), ("graph", "mixed")]
    df = spark.createDataFrame([(q,) for q, _ in rows], "q string")
    assert [r.t for r in df.select(Q.intent(F.col("q"))["type"].alias("t")).collect()] == [t for _, t in rows]


def test_filter_expression():
    p = P.parse_expression('lang:py,go "src/a b" ext=.js C:\\x kind: bad:1')
    assert p.lang == ["py", "go"] and p.file == ["src/a b", "C:\\x"] and p.ext == [".js"] and p.errors == ["missing value for kind", "unknown filter key bad"]
    with pytest.raises(P.Impossible):
        P.meet(["a"], ["b"])
    assert P.meet(None, ["b"]) == ["b"] and P.meet(["a", "b"], ["b"]) == ["b"]


def test_filters_on_nulls_and_odd_values(spark):
    df = spark.createDataFrame([(1, ".\\src\\A.py", ".PY", "Py", ["X", None]), (2, None, None, None, None), (3, "b.rs", "", "unknown", []), (4, "c", "js", " JS ", ["xy"])], "id int, f string, e string, l string, x array<string>")
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(P.path_matches(F.col("f"), ["SRC/a"])) == [1] and ids(P.path_matches(F.col("f"), ["/^b\\.r/"])) == [3] and ids(P.path_matches(F.col("f"), ["/((a+)+)$/"])) == []
    assert ids(P.ext_matches(F.col("e"), F.col("f"), ["py", "*.rs"])) == [1, 3]
    assert ids(P.lang_matches(F.col("l"), ["python", "node"])) == [1, 4] and ids(P.lang_matches(F.col("l"), ["unknown"])) == [2, 3]
    assert ids(P.list_contains(F.col("x"), ["x"])) == [1, 4] and ids(P.has_member(F.col("x"), ["x"])) == [1]


def test_dates(spark):
    texts = ["2033-04-30T12:19:05.250+02:00", "2034-01-31T05:31:45Z", "2033-07-11 13:52", "2001891989", "2001891989000", "nonsense", "", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.parsed_time(F.col("t")).cast("string").alias("t")).collect()]
    assert got[:4] == ["2033-04-30 10:19:05.25", "2034-01-31 05:31:45", "2033-07-11 13:52:00", "2033-06-09 01:06:29"] and got[4] == got[3] and got[5:] == [None, None, None]


def test_list_filters(spark):
    df = spark.createDataFrame([(1, ["x"], [("req", "Eval")], [("Sec", "r1", ["A", "b"])]), (2, [], [], []), (3, None, None, None), (4, ["y"], [(None, "eval")], [("sec", "r2", None), ("other", "r1", ["a"])])],
                               "id int, lint array<string>, flows array<struct<source:string,sink:string>>, structural array<struct<pack:string,rule:string,tags:array<string>>>")
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(P.has_items(F.col("lint"))) == [1, 4] and ids(P.flow_matches(F.col("flows"), ["REQ->ev"])) == [1]
    assert ids(P.structural_matches(F.col("structural"), pack="sec", rule="r1", tag="a")) == [1] and ids(P.structural_matches(F.col("structural"), rule="r1")) == [1, 4]

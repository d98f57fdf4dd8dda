import json
import random

from pyspark.sql import functions as F

from quernstone.operators import chunking as C, diff as D, evaluation as E, findings, graph as G, keyed, nested, risk as K, similarity as S, symbols as Y
from quernstone.functions import text as X, vectors as V
from quernstone.runtime import latest
from quernstone.sources.payloads import aligned, unpack_payloads, unwrapped


def test_latest_keeps_one_state_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None), (2, "d", None), (None, "e", 1), (None, "f", 2)], "k int, v string, t int")
    assert sorted(r.v for r in latest(df, ["k"], "t").collect()) == ["b", "d", "e", "f"]


def test_top_n_and_ranks_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}", rnd.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, s int, i int")
    got = {(r.k, r.i) for r in keyed.top_n(df, ["k"], [F.desc("s"), F.asc("i")], 7).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        want |= {(k, r[2]) for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:7]}
    assert got == want
    ranks = {}
    for r in keyed.spread_rank(df, ["k"], "i").collect():
        ranks.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())


def bfs(edges, seeds, depth):
    seen, front = {s: 0 for s in seeds}, set(seeds)
    for d in range(1, depth + 1):
        front = {b for a, b in edges if a in front and b not in seen}
        seen.update({n: d for n in front})
    return seen


def test_neighborhood_equals_brute_force_with_cycles_and_a_hub(spark):
    rnd = random.Random(8)
    edges = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(60)] + [("hub", f"n{i}") for i in range(30)] + [("n1", "n1"), ("n2", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    for direction in ("out", "in", "both"):
        pairs = [(a, b) for a, b in edges if b] if direction == "out" else [(b, a) for a, b in edges if b] if direction == "in" else [(x, y) for a, b in edges if b for x, y in ((a, b), (b, a))]
        got = {r.node: r.distance for r in G.neighborhood(df, spark.createDataFrame([("n1",), ("lost",), (None,)], "node string"), 3, direction).collect()}
        assert got == bfs(pairs, ["n1", "lost"], 3)
    capped = G.neighborhood(df, spark.createDataFrame([("hub",)], "node string"), 1, fanout=5).collect()
    assert len(capped) == 6
    t = {r.src: r.omitted for r in G.truncation(df, 5).collect()}
    assert t["hub"] == 25


def test_architecture_rules(spark):
    edges = spark.createDataFrame([("core/a.js", "app/b.js", "import"), ("app/b.js", "core/a.js", "import"), ("core/x/y.js", "lib/z.js", "call")], "src string, dst string, kind string")
    rules = [G.Rule("no-app", "forbiddenImport", G.Selector(["core/**"]), G.Selector(["app/**"], ["app/ok.js"])), G.Rule("layers", "layering", layers=[G.Selector(["core/**"]), G.Selector(["app/**"])]), G.Rule("calls", "forbiddenCall", G.Selector(["core/**"]), G.Selector(["lib/*.js"]))]
    assert {(r.rule, r.src) for r in G.violations(edges, rules).collect()} == {("no-app", "core/a.js"), ("layers", "core/a.js"), ("calls", "core/x/y.js")}


def test_better_edges_and_filters(spark):
    e = spark.createDataFrame([("call", "a", "b", 0.5, None), ("call", "a", "b", 0.5, "x"), ("call", "a", "b", None, "y"), ("use", "a", "b", 0.1, None)], "kind string, src string, dst string, confidence double, evidence string")
    assert {(r.kind, r.confidence, r.evidence) for r in G.better_edges(e).collect()} == {("call", 0.5, "x"), ("use", 0.1, None)}
    assert G.filter_edges(e, ["call"], 0.4).count() == 3


def test_file_changes_pair_copies_by_rank(spark):
    before = spark.createDataFrame([(f"old{i}", "same", 1) for i in range(30)] + [("keep", "k", 1), ("mod", "m1", 5), ("zero", "z", 0)], "path string, hash string, size int")
    after = spark.createDataFrame([(f"new{i}", "same", 1) for i in range(20)] + [("keep", "k", 1), ("mod", "m2", 5), ("zero", "z", None), ("add", "n", 1)], "path string, hash string, size int")
    s = {r.kind: r.n for r in D.summary(D.file_changes(before, after)).collect()}
    assert s == {"renamed": 20, "removed": 10, "modified": 1, "added": 1}
    assert D.file_changes(before.limit(0), after.limit(0)).count() == 0


def test_chunk_changes(spark):
    cols = "uid long, chunk_id string, logical string, start int, end int, hash string"
    before = spark.createDataFrame([(1, "c1", "l1", 0, 5, "h"), (2, "c2", "l2", 0, 5, "h"), (3, "c3", "l3", 0, 5, "h"), (4, "c4", "l4", 0, 5, "h")], cols)
    after = spark.createDataFrame([(11, "c1", "l1", 2, 5, "h"), (12, "x2", "l2", 0, 5, "g"), (14, "c4", "l4", 0, 5, "h"), (15, "c5", "l5", 0, 5, "h")], cols)
    assert {(r.kind, r.logical) for r in D.chunk_changes(before, after).collect()} == {("moved", "l1"), ("modified", "l2"), ("removed", "l3"), ("added", "l5")}


def test_imports(spark):
    files = spark.createDataFrame([("r", "src/a.js"), ("r", "src/lib/index.ts"), ("r", "src/b.ts"), ("s", "src/c.js")], "repo string, path string")
    i = spark.createDataFrame([("r", "src/x/m.js", s) for s in ("../a.js", "../lib", "../b", "../lib/", "./none", "../../../up", "react", "../c.js")], "repo string, src string, spec string")
    got = {r.spec: (r.dst, r.status, r.reason) for r in Y.resolve_imports(i, files).collect()}
    assert got["../a.js"][0] == "src/a.js" and got["../lib"][0] == got["../lib/"][0] == "src/lib/index.ts" and got["../b"][0] == "src/b.ts"
    assert got["react"][1] == "external" and got["../../../up"][2] == "outside_root" and got["./none"][2] == "missing_candidates" and got["../c.js"][2] == "missing_file"


def test_imports_by_language(spark):
    files = [("r", p) for p in ("pkg/a.py", "pkg/__init__.py", "pkg/sub/b.py", "top/c.py", "src/x/mod.rs", "src/y.rs", "src/z/w.rs", "lib/net/n.go", "c/a.h", "include/b.h", "web/i/index.ts", "web/m.ts")]
    given = [
        ("pkg/sub/b.py", "..a", "pkg/a.py", "resolved", "extension"), ("pkg/sub/b.py", "..", "pkg/__init__.py", "resolved", "index"), ("pkg/a.py", ".sub.b", "pkg/sub/b.py", "resolved", "extension"), ("pkg/a.py", "top.c", "top/c.py", "resolved", "extension"),
        ("pkg/a.py", "numpy.random", None, "external", None), ("pkg/a.py", "...x", None, "unresolved", None), ("src/y.rs", "crate::x::Thing", "src/x/mod.rs", "resolved", "parent"), ("src/z/w.rs", "super::y", "src/y.rs", "resolved", "extension"),
        ("src/y.rs", "std::io", None, "external", None), ("src/y.rs", "self::q::R", None, "unresolved", None), ("m/a.go", "host.x/lib/net", "lib/net", "resolved", "folder"), ("m/a.go", "fmt", None, "external", None), ("c/m.c", "a.h", "c/a.h", "resolved", "beside"),
        ("c/m.c", "b.h", "include/b.h", "resolved", "include"), ("c/m.c", "stdio.h", None, "external", None), ("web/a.js", "./i", "web/i/index.ts", "resolved", "index"), ("web/a.js", "./m", "web/m.ts", "resolved", "extension"), ("web/a.js", "react", None, "external", None)]
    imports = spark.createDataFrame([("r", s, p) for s, p, *_ in given], "repo string, src string, spec string")
    got = {(r.src, r.spec): (r.dst, r.status, r.stage) for r in Y.resolve_imports(imports, spark.createDataFrame(files, "repo string, path string")).collect()}
    assert got == {(s, p): tuple(rest) for s, p, *rest in given}
    assert {r.spec: r.reason for r in Y.resolve_imports(imports, spark.createDataFrame(files, "repo string, path string")).filter("status = 'unresolved'").collect()} == {"...x": "outside_root", "self::q::R": "missing_candidates"}


def test_name_resolution(spark):
    symbols = spark.createDataFrame([(1, "r", "a", "f"), (2, "r", "b", "f"), (3, "r", "b", "g"), (4, "s", "a", "f")], "symbol_id long, repo string, file string, name string")
    refs = spark.createDataFrame([("own", "r", "a", "f"), ("two", "r", "c", "f"), ("one", "r", "c", "g"), ("none", "r", "c", "h"), ("null", "r", "c", None)], "ref_id string, repo string, file string, name string")
    got = {r.ref_id: (r.status, r.symbol_id) for r in Y.resolve_names(refs, symbols).collect()}
    assert got == {"own": ("resolved", 1), "two": ("ambiguous", None), "one": ("resolved", 3), "none": ("unresolved", None), "null": ("unresolved", None)}


def test_names_by_file_import_repo_and_last_part(spark):
    symbols = spark.createDataFrame([(1, "r", "a", "f"), (2, "r", "b", "f"), (3, "r", "b", "mod.g"), (4, "r", "d", "g"), (5, "r", "d", "x::h"), (6, "s", "a", "h")], "symbol_id long, repo string, file string, name string")
    imports = spark.createDataFrame([("r", "c", "b"), ("r", "c", None), ("r", "e", "d")], "repo string, src string, dst string")
    refs = spark.createDataFrame([("imported", "r", "c", "f"), ("leaf_of_symbol", "r", "c", "g"), ("qualified", "r", "e", "lib.g"), ("whole_first", "r", "z", "g"), ("leaf_in_repo", "r", "z", "h"), ("other_repo", "t", "z", "h")], "ref_id string, repo string, file string, name string")
    got = {r.ref_id: (r.status, r.symbol_id, r.level) for r in Y.resolve_names(refs, symbols, imports, keep=["name"]).collect()}
    assert got == {"imported": ("resolved", 2, "import"), "leaf_of_symbol": ("resolved", 3, "import"), "qualified": ("resolved", 4, "import"), "whole_first": ("resolved", 4, "repo"), "leaf_in_repo": ("resolved", 5, "repo"), "other_repo": ("unresolved", None, None)}


def test_walks_within_caps_equal_brute_force(spark):
    import random

    rnd = random.Random(8)
    pairs = sorted({(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(160)} | {("n0", f"n{i}") for i in range(30)})
    df = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n5",), ("n0",)], "node string")

    def walk(depth, caps):
        steps, cut = {}, set()
        for a, b in pairs:
            steps.setdefault(a, []).append(b)
        if caps.fanout is not None:
            cut |= {"fanout"} if any(len(v) > caps.fanout for v in steps.values()) else set()
            steps = {k: sorted(v)[: caps.fanout] for k, v in steps.items()}
        seen, frontier, work, edges = {"n0": 0, "n5": 0}, ["n0", "n5"], 0, set()
        for d in range(1, depth + 1):
            looked = sorted((a, b) for a in frontier for b in steps.get(a, []))
            if caps.work is not None and work + len(looked) > caps.work:
                cut.add("work")
                looked = looked[: caps.work - work]
            work += len(looked)
            fresh = sorted({b for _, b in looked} - seen.keys())
            if caps.nodes is not None and len(seen) + len(fresh) > caps.nodes:
                cut.add("nodes")
                fresh = fresh[: caps.nodes - len(seen)]
            seen.update({b: d for b in fresh})
            edges |= set(looked)
            frontier = fresh
            if not fresh or (caps.nodes is not None and len(seen) >= caps.nodes) or (caps.work is not None and work >= caps.work):
                break
        edges = {(a, b) for a, b in edges if b in seen}
        if caps.edges is not None and len(edges) > caps.edges:
            cut.add("edges")
            edges = set(sorted(edges)[: caps.edges])
        return seen, edges, cut

    for caps in (G.Caps(), G.Caps(fanout=3), G.Caps(nodes=12), G.Caps(work=40), G.Caps(edges=15), G.Caps(fanout=5, nodes=20, edges=25, work=60)):
        nodes, edges, cut = G.bounded_walk(df, seeds, 3, "out", caps)
        want = walk(3, caps)
        assert ({r.node: r.distance for r in nodes.collect()}, {tuple(r) for r in edges.collect()}, {r.cap for r in cut.collect()}) == want, caps
    none, _, _ = G.bounded_walk(df.limit(0), seeds.limit(0), 2, "both", G.Caps(nodes=5))
    assert none.count() == 0


def test_tests_are_suggested_by_import_then_by_name(spark):
    imports = spark.createDataFrame([("t/direct.test.js", "src/a.js"), ("t/far.test.js", "src/mid.js"), ("src/mid.js", "src/a.js")], "src string, dst string")
    changed = spark.createDataFrame([("src/a.js",)], "node string")
    files = spark.createDataFrame([(p, p, ".test." in p) for p in ("src/a.js", "t/direct.test.js", "t/far.test.js", "u/a.test.js", "src/deep/b.test.js", "u/c.test.js", "src/mid.js")], "node string, path string, is_test boolean")
    got = {r.node: (r.distance, round(r.score, 4)) for r in G.suggest_tests(imports, changed, F.col("node").contains(".test."), 4, files).collect()}
    assert got == {"t/direct.test.js": (1, 0.5), "t/far.test.js": (2, 0.3333), "u/a.test.js": (None, 0.5), "src/deep/b.test.js": (None, 0.25)}


def test_ranks_of_a_hot_key(spark):
    from quernstone.operators.keyed import ordered_rank

    rows = [("hot", i, (i * 7919) % 5003) for i in range(3000)] + [("cold", i, i % 3) for i in range(20)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r.k, r.i): r.rank for r in ordered_rank(df, ["k"], [F.desc("v"), F.asc("i")]).collect()}
    for key in ("hot", "cold"):
        order = sorted((-v, i) for k, i, v in rows if k == key)
        assert all(got[key, i] == n for n, (_, i) in enumerate(order, 1))


def test_taint_lines():
    rules = K.RULES
    text = "const a = req.body.x;\nlet b = a + 1;\neval(b);\nb = escape(b);\neval(b);\n// eval(a)\nif (a == b) eval(a);\nexec(process.env.X)"
    got = [(n, s, k) for n, s, k, _ in K.scan(text, rules)]
    assert got == [(3, "request-body", "eval"), (7, "request-body", "eval"), (8, "environment", "command")]
    assert K.scan("", rules) == []


def test_interprocedural_and_rollup(spark):
    chunks = spark.createDataFrame([(1, "x = req.body"), (2, "escape(y)"), (3, "eval(z)"), (4, "nothing"), (5, None)], "id long, text string")
    found = K.signals(chunks)
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4)], "src long, dst long")
    flows = [(r.source_id, r.sink_id, r.hops, r.confidence) for r in K.interprocedural(found, calls).collect()]
    assert flows == [(1, 3, 2, round((0.6 * 0.8) ** 0.5 * 0.85**2 * 0.9, 6))]
    r = {x.id: (x.categories, x.severity) for x in K.rollup(found).collect()}
    assert r == {1: (["input"], "low"), 2: ([], None), 3: (["code-exec"], "critical")}
    assert json.loads(K.sarif(K.local_flows(spark.createDataFrame([(9, "eval(req.body)")], "id long, text string"))).first()[0])["ruleId"] == "eval"


def test_content_cuts_cover_and_survive_insertions():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh \n") for _ in range(20000))
    a = C.content_cuts(text, 64, 256, 1024)
    assert a[0][0] == 0 and a[-1][1] == len(text) and all(x[1] == y[0] for x, y in zip(a, a[1:])) and all(y - x <= 1024 for x, y in a)
    b = C.content_cuts("inserted" + text, 64, 256, 1024)
    pieces = lambda t, c: {t[x:y] for x, y in c}
    assert len(pieces(text, a) & pieces("inserted" + text, b)) > len(a) * 0.8
    for low, high in ((64, 1024), (40, 90), (200, 210)):
        mixed = text[:3000] + "漢😀é" * 200
        assert C.content_cuts(mixed, low, 256, high) == C._slow_cuts(mixed, max(low, 64), high, 255)
    assert C.content_cuts("short", 1, 4, 9, least=100) == [(0, 5)] and C.content_cuts("", 1, 4, 9) == []


def test_byte_pieces_never_split_characters(spark):
    df = spark.createDataFrame([(1, "aé漢😀" * 50), (2, ""), (3, None)], "k long, t string")
    rows = C.byte_pieces(df, "k", "t", 7).orderBy("piece").collect()
    assert {r.k for r in rows} == {1} and rows[0].start == 0 and rows[-1].end == 200 and all(r.bytes <= 7 for r in rows)


def test_word_segmentation():
    words = frozenset(["look", "lookup", "up", "graph", "a", "ab", "bc", "cd"])
    assert C.segment_word("lookupgraph", words) == ["lookup", "graph"]
    assert C.segment_word("abcd", words) == ["ab", "cd"]
    assert C.segment_word("xlookz", words) == ["x", "look", "z"] and C.segment_word("", words) == []


def test_segments_of_markdown(spark):
    text = "---\ntitle: x\n---\n# A\n```js\nf()\n```\ntext\n~~~\nplain\n~~~\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    assert [(r.language, r.code) for r in C.fenced(df, "k", "t").collect()] == [("js", "f()"), ("", "plain")]
    assert [r.f for r in df.select(C.front_matter(F.col("t")).alias("f")).collect()] == ["title: x", None, None]


def test_statements(spark):
    df = spark.createDataFrame([(1, "SELECT ';' FROM a JOIN b.c; -- x;\nINSERT INTO d VALUES (1);;")], "k long, t string")
    s = C.statements(df, "k", "t").withColumn("refs", C.table_refs(F.col("statement"))).orderBy("n").collect()
    assert [r.statement for r in s] == ["SELECT ';' FROM a JOIN b.c", "INSERT INTO d VALUES (1)"] and [r.refs for r in s] == [["a", "b.c"], ["d"]]


def test_minhash_equals_its_definition(spark):
    def fold(token, k):
        h = k
        for c in token:
            h = (h * 31 + ord(c)) % 2**32
        return h
    tokens = ["graph", "lease", "x", "graph"]
    df = spark.createDataFrame([(1, tokens, 9), (2, [], 9), (3, None, 9), (4, [None, "x"], 9)], "k long, t array<string>, signature int")
    got = {r.k: r.signature for r in S.minhash(df, "k", "t").collect()}
    assert got == {1: [min(fold(t, k) for t in tokens) for k in range(1, 129)], 4: [fold("x", k) for k in range(1, 129)]}


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(80)] + [(200, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {(r.query_id, r.rank): r.id for r in S.nearest(df, df.filter("vec_id % 10 = 0 and embedding is not null"), 4).collect()}
    for q in range(0, 80, 10):
        best = sorted((r for r in rows if r[1]), key=lambda r: (-sum(a * b for a, b in zip(r[1], rows[q][1])), r[0]))[:4]
        assert [got[q, k + 1] for k in range(4)] == [r[0] for r in best]
    assert S.nearest(df, df.limit(0), 4).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], None), (None, [2.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(V.unit(F.col("a")).alias("u"), V.merge(F.col("a"), F.col("b")).alias("m"), V.fitted(V.quantize(F.col("a"), 0, 4, 5), 3, 9).alias("f")).collect()
    assert r[0].u == [0.6, 0.8] and r[1].u == [0.0, 0.0] and r[0].m == [2.0, 2.0] and r[1].m == [0.0, 0.0] and r[2].m == [2.0, 2.0]
    assert r[0].f == [3, 4, 9] and r[2].f == [9, 9, 9]


def test_text_functions(spark):
    df = spark.createDataFrame([("parseHTTPReq_v2-x",), ("",), ("Schpfö",), (None,)], "t string")
    assert [r.x for r in df.select(X.split_identifier(F.col("t")).alias("x")).collect()] == [["parse", "h", "t", "t", "p", "req", "v2", "x"], [], ["schpf"], None]
    g = df.select(X.token_ngrams(X.split_identifier(F.col("t")), 2, 3, " ").alias("g")).first().g
    assert g[:2] == ["parse h", "h t"] and g[-1] == "req v2 x"
    assert [r.w for r in df.select(F.size(X.windows(F.col("t"), 5)).alias("w")).collect()][:3] == [4, 0, 2]


def test_ranking_quality(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c")], "query_id string, rank int, item string")
    expected = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b"), ("p", "a")], "query_id string, item string")
    r = {x.query_id: (x.recall, x.rr, round(x.ndcg, 4)) for x in E.ranking_quality(hits, expected, 2).collect()}
    assert r == {"q": (0.5, 0.5, round((1 / 1.5849625) / (1 + 1 / 1.5849625), 4)), "p": (0.0, 0.0, 0.0)}


def test_nested_tables_store_equal_objects_once(spark):
    schema = "id long, v struct<a:string,items:array<struct<n:string,k:struct<x:int>>>,m:map<string,string>>"
    rows = [(1, ("p", [("n1", (1,)), None, ("n2", (1,)), ("n1", (1,))], {"b": "1", "a": "2"})), (2, ("p", [("n1", (1,)), None, ("n2", (1,)), ("n1", (1,))], {"a": "2", "b": "1"})), (3, None), (4, (None, None, None)), (5, ("p", [], {}))]
    t = nested.flat_tables(spark.createDataFrame(rows + rows[:1], schema), ["id"], ["v"])
    assert set(t) == {"v", "v.items", "v.items.k"}
    assert t["v"].objects.count() == 3 and t["v"].bridge.count() == 4
    assert t["v.items"].objects.count() == 2 and sorted((r.id, r.ordinal) for r in t["v.items"].bridge.collect()) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 2), (2, 3)]
    assert t["v.items.k"].objects.count() == 1
    parents = {r.object_id for r in t["v.items"].bridge.collect()}
    assert {r.parent_id for r in t["v.items.k"].bridge.collect()} == parents


def test_payload_alignment(spark):
    assert unwrapped('{"alerts": [{"body": "{\\"a\\": 1}"}]}', {"a"}) == [{"a": 1}]
    assert unwrapped("[]", {"a"}) == [] and unwrapped("nonsense", {"a"}) == []
    assert unwrapped([{"a": 1}, {"records": [{"a": 2}, '{"a": 3}']}, 5], {"a"}) == [{"a": 1}, {"a": 2}, {"a": 3}]
    deep = {"a": 1}
    for _ in range(60):
        deep = {"data": [deep]}
    assert unwrapped(deep, {"a"}) == [{"a": 1}]
    df = spark.createDataFrame([(1, None, '{"Pack_Age": {"packageName": " x ", "v": 2}}'), (2, None, '{"package": '), (3, ("y",), '{"package": {"name": "z"}}'), (4, None, None), (5, None, '{"record": {"package": "{\\"name\\": \\"w\\"}"}}')], "id long, package struct<name:string>, payload string")
    got = {r.id: r.package and r.package.name for r in unpack_payloads(df, "payload", ["package"], {"name": ["packagename"]}).collect()}
    assert got == {1: " x ", 2: None, 3: "y", 4: None, 5: "w"}
    kind = df.schema["package"].dataType
    assert aligned([{"n": 1}], kind, {}) == [{"name": None}]
    assert aligned([{"name": "a"}, {"name": "b"}], kind, {}) == [{"name": "a"}, {"name": "b"}]
    many = spark.createDataFrame([(1, None, '[{"package": {"name": "a"}}, {"package": [{"name": "b"}, {"name": "c"}]}]'), (2, None, "[]")], "id long, package struct<name:string>, payload string")
    assert sorted((r.id, r.package and r.package.name) for r in unpack_payloads(many, "payload", ["package"], {}).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, None)]


def test_findings_on_empty_and_odd_tables(spark, tmp_path):
    from tests.conftest import write_tables

    ins = "rec_id long, packageVulnerabilityDetails struct<vulnerabilityId:string,vulnerablePackages:array<struct<name:string,version:string>>>, payload string, ingested_at timestamp, name string"
    dep = "rec_id long, security_vulnerability struct<package:struct<name:string,ecosystem:string>>, dependency struct<package:struct<name:string,ecosystem:string>>, payload string, ingested_at timestamp"
    gen = "rec_id long, package struct<name:string,ecosystem:string>, payload string, ingested_at timestamp"
    rows = [(1, ("v", [None, ("a ", "1"), ("", "1"), ("a ", "1")]), None, None, "clash")] * 2 + [(2, None, '{"vulnerabilityDetails": {"package": {"packageName": "b"}}}', None, "clash"), (None, ("v", [("c", "1")]), None, None, "x")]
    folder = write_tables(spark, tmp_path, inspector=(rows, ins), dependabot=([], dep), generic=([(7, ("\tg\n", "e"), None, None)], gen))
    assert {tuple(r) for r in findings.p2_found(spark, folder).collect()} == {("inspector", 1, "vulnerablepackages", 1, "a"), ("inspector", 1, "vulnerablepackages", 3, "a"), ("inspector", 2, "vulnerablepackages", 0, "b"), ("generic", 7, "package", 0, "g")}


def test_flows_are_ranked(spark):
    flows = spark.createDataFrame([(1, 2, "s", "low", 1, 0.9), (1, 3, "s", "high", 2, 0.5), (1, 4, "s", "low", 3, 0.1), (9, 2, "s", "high", 1, 0.2)], "source_id long, sink_id long, source string, sink string, hops int, confidence double")
    top = K.ranked(flows, spark.createDataFrame([(4,)], "id long"), F.col("sink"), 2)
    assert {(r.source_id, r.sink_id) for r in top.collect()} == {(1, 4), (1, 3), (9, 2)}


def test_sections_of_every_file(spark, sf_dir):
    import re

    import __spark_entry__ as entry
    from quernstone.operators import tables
    from quernstone.operators.chunking import HEADINGS

    want, suffixes = set(), set()
    for r in tables.files(spark, sf_dir, "suffix", "content").filter("content is not null").collect():
        lines = re.split("\r\n?|\n", r.content)
        pattern = HEADINGS.get(r.suffix)
        heads = [n for n, x in enumerate(lines, 1) if pattern and re.search(pattern, x, re.A)]
        suffixes.add(r.suffix)
        for k, n in enumerate(heads):
            want.add((r.file_id, k + 1, lines[n - 1].strip(" "), n, heads[k + 1] - 1 if k + 1 < len(heads) else len(lines)))
        if not heads:
            want.add((r.file_id, 1, "root", 1, len(lines)))
    assert {"js", "ts", "c", "json"} <= suffixes
    got = [tuple(r) for r in entry.queries()["t15_sections"](spark, sf_dir).select("file_id", "section", "title", "start_line", "end_line").collect()]
    assert len(got) == len(want) and set(got) == want


def test_phrases_of_many_chunks_stay(spark, sf_dir, tmp_path):
    import re
    from collections import Counter

    import __spark_entry__ as entry
    from quernstone.operators import tables
    from pyspark.sql import functions as F

    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    more = chunks.orderBy("id").limit(1).withColumn("id", F.explode(F.sequence(F.lit(10**9), F.lit(10**9 + 300)))).withColumn("mode", F.lit("code")).withColumn("ngrams", F.array(F.lit("very_common"), F.lit("very\x01common")))
    chunks.unionByName(more.select(chunks.columns)).coalesce(1).write.parquet(f"{tmp_path}/chunks.parquet")
    want = Counter()
    for r in tables.chunks(spark, str(tmp_path), "mode", "ngrams").collect():
        grams = {re.sub(r"[\x01_\s]+", " ", g, flags=re.A).strip(" ") for g in r.ngrams or [] if g is not None}
        want.update((r.mode, g) for g in grams if g)
    got = {(r.mode, r.gram): r.chunks for r in entry.queries()["a06_phrase_postings"](spark, str(tmp_path)).collect()}
    assert got == dict(want) and got["code", "very common"] == 301


def test_flat_tables_of_findings_equal_brute_force(spark, sf_dir):
    import json

    import pyarrow.parquet as pq

    from quernstone.operators import findings

    got = {(r.source, r.path): (r.occurrences, r.objects) for r in findings.p2_objects(spark, sf_dir).collect()}
    want = {}

    def form(v):
        if isinstance(v, dict):
            return {k: form(x) for k, x in v.items()}
        return [form(x) for x in v] if isinstance(v, (list, tuple)) else v

    def walk(source, path, value, key, parent):
        items = list(enumerate(value)) if isinstance(value, list) else [(0, value)]
        for i, v in items:
            if isinstance(v, dict):
                me = json.dumps(form(v), sort_keys=True)
                bridge, objects = want.setdefault((source, path), (set(), set()))
                bridge.add((key, parent, me, i))
                objects.add(me)
                for k, x in v.items():
                    if isinstance(x, dict) or (isinstance(x, list) and any(isinstance(y, dict) for y in x)):
                        walk(source, f"{path}.{k}", x, key, me)

    for source, (columns, aliases, places) in findings.SOURCES.items():
        kind = spark.read.parquet(f"{sf_dir}/{source}.parquet").schema
        telling = [c for c in columns if any(p.split(".")[0] == c for p in places)]
        rows = [r for r in pq.read_table(f"{sf_dir}/{source}.parquet").to_pylist() if r["rec_id"] is not None]
        last = {}
        for r in rows:
            last[r["rec_id"]] = max(last.get(r["rec_id"], r["ingested_at"]), r["ingested_at"])
        for r in rows:
            if r["ingested_at"] != last[r["rec_id"]]:
                continue
            records = [r]
            if all(r[c] is None for c in telling) and r["payload"] is not None:
                try:
                    value = json.loads(r["payload"])
                except ValueError:
                    value = None
                names = {c.lower().replace("_", "") for c in columns} | {a for c in columns for a in aliases.get(c.lower().replace("_", ""), [])}
                part = type(kind)([f for f in kind.fields if f.name in columns])
                records = [{c: r[c] if r[c] is not None else f[c] for c in columns} for v in unwrapped(value, names) for f in aligned(v, part, aliases)] or [r]
            for rec in records:
                for c in columns:
                    v = rec[c]
                    if c == "resources" and v is not None:
                        v = [x and {**x, "tags": sorted(dict(x["tags"]).items()) if x["tags"] is not None else None} for x in v]
                    walk(source, c, v, r["rec_id"], None)
    assert len(got) >= 12
    assert {k: (len(b), len(o)) for k, (b, o) in want.items()} == {k: v for k, v in got.items() if v[0]}


def test_pruned_search_is_exact(spark):
    import random

    from quernstone.operators import similarity as S

    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in centres[i % 5]] if i % 31 else None) for i in range(600)] + [(900 + i, centres[0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 40 = 3 or vec_id = 900")
    c = S.centroids(df, lists=8)
    got = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in S.pruned_nearest(S.listed(df, c), c, asked, 7, probes=2).collect()}
    want = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in S.nearest(df, asked, 7).collect()}
    assert got == want and len(got) > 50
    none = df.limit(0)
    assert S.pruned_nearest(S.listed(none, c), c, asked, 3).count() == 0 and S.pruned_nearest(S.listed(df, c), c, none, 3).count() == 0


def test_signatures_of_large_indexes_are_shortened(spark):
    from quernstone.operators import similarity as S

    assert S.sampling_plan(100, 200) == (1, 128) and S.sampling_plan(1000, 250) == (4, 32) and S.sampling_plan(10**6, 10) == (8, 16) and S.sampling_plan(5, 0) == (1, 128)
    df = spark.createDataFrame([(list(range(10)),)], "s array<int>")
    assert df.select(S.shortened(F.col("s"), 3, 4).alias("s")).first().s == [0, 3, 6, 9]


def test_minhash_search_equals_brute_force(spark, monkeypatch):
    import random

    from quernstone.operators import similarity as S

    rnd = random.Random(12)
    base = [[rnd.randrange(2**32) for _ in range(16)] for _ in range(6)]
    rows = [(i, [v if rnd.random() < 0.7 else rnd.randrange(50) for v in base[i % 6]]) for i in range(300)] + [(400 + i, base[0]) for i in range(9)] + [(500, None)]
    df = spark.createDataFrame(rows, "doc_id long, signature array<long>").repartition(3)
    asked = [i for i, _ in rows if i % 20 == 0 and i != 500]
    sig = {i: s for i, s in rows if s}
    want = {}
    for q in asked:
        scored = sorted((-sum(a == b for a, b in zip(sig[q], s)), i) for i, s in sig.items() if i != q)
        want[q] = [(i, -n / 16) for n, i in scored if n][:5]
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "SLICE", 40)
    got = {}
    for r in sorted(S.minhash_nearest(df, df.filter(F.col("doc_id").isin(asked)), 5).collect(), key=lambda r: (r.query_id, -r.score, r.doc_id)):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == want
    assert S.minhash_nearest(df.limit(0), df, 5).count() == 0 and S.minhash_nearest(df, df.limit(0), 5).count() == 0


def test_intervals_meet_by_stretches(spark):
    import random

    from quernstone.operators import chunking as C

    rnd = random.Random(13)
    span = lambda n, w: (lambda a: (a, a + rnd.randrange(w)))(rnd.randrange(n))
    chunks = [(f"f{i % 3}", i, *span(900, 300)) for i in range(120)] + [("f0", 900, 50, 10), ("f0", 901, None, 5)]
    spans = [(f"f{i % 2}", f"m{i}", *span(900, 200)) for i in range(80)] + [("f0", "bad", 9, 3)]
    c = spark.createDataFrame(chunks, "file_id string, id long, startLine long, endLine long")
    m = spark.createDataFrame(spans, "file_id string, match string, m_start long, m_end long")
    got = [(r.id, r.match) for r in C.line_matches(m, c).collect()]
    assert sorted(got) == sorted((i, k) for f, i, a, b in chunks if a is not None for g, k, x, y in spans if f == g and x <= b and a <= y)
    ok = [x for x in chunks if None not in x and x[2] <= x[3]]
    wide = [(f, i, a * 40, b * 40 + 1) for f, i, a, b in ok]
    blocks = [(f, a * 40, b * 40) for f, _, a, b in spans[:20]]
    shares = {r.id: r.share for r in C.coverage(spark.createDataFrame(blocks, "file_id string, b_start long, b_end long"), spark.createDataFrame(wide, "file_id string, id long, start long, `end` long")).collect()}
    want = {i: max((max(min(b, y) - max(a, x), 0) / (b - a) for g, x, y in blocks if g == f), default=None) for f, i, a, b in wide}
    assert {k: round(v, 9) for k, v in shares.items()} == {k: round(v, 9) for k, v in want.items() if v is not None}


def test_stored_tables_keep_types_and_follow_their_sources(spark, tmp_path):
    from quernstone.runtime import stored, table

    def put(rows):
        spark.createDataFrame(rows, "mode string, n int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))

    made = []

    def get():
        return sorted(tuple(r) for r in stored(spark, str(tmp_path), "copy", ("t",), lambda: made.append(1) or table(spark, str(tmp_path), "t"), by="mode").select("mode", "n").collect())

    put([("007", 1), ("7", 2)])
    assert get() == get() == [("007", 1), ("7", 2)] and len(made) == 1
    put([("007", 1), ("7", 2), ("x", 3)])
    assert get() == [("007", 1), ("7", 2), ("x", 3)] and len(made) == 2

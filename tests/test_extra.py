import pytest

from quernstone.functions.stem import stem, stem_token
from quernstone.operators.snapshots import Snapshots
from pyspark.sql import functions as F

from quernstone.plans import policies as P
from quernstone.queries.extra import generated_queries


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "running": "run", "hopping": "hop", "hoping": "hope", "happily": "happili", "relational": "relat", "generously": "generous", "skies": "sky", "dying": "die",
        "national": "nation", "conditional": "condit", "fluently": "fluentli", "agreed": "agre", "feed": "feed", "plastered": "plaster", "sky": "sky", "sing": "sing", "cries": "cri", "by": "by", "say": "say", "consistency": "consist",
        "knightly": "knight", "adjustment": "adjust", "controlling": "control", "sensational": "sensat", "electricity": "electr", "hopeful": "hope", "probate": "probat", "rate": "rate", "kilos": "kilo", "gas": "gas", "this": "this",
    }
    assert {w: stem(w) for w in pairs} == pairs
    assert stem_token("tie") == "tie" and stem_token("größe") == "größe" and stem_token("ties") == "tie"


def test_expansion():
    words = frozenset(["look", "up", "graph"])
    assert P.expand("lookupgraph", words) == ["look", "up", "graph"] and P.expand("Graph", words) == ["graph"] and P.expand("ABC", words, True) == ["ABC"]
    assert P.stems(["running"], "auto", "en") == ["run"] and P.stems(["running"], "auto") == ["running"]
    assert P.cjk_tokens("日本語") == ["日本語", "日本", "本語"] and P.cjk_tokens("") == []


def test_policies(spark):
    grid = [(None, None, False), (0, 5, True), (0, 0, True), (5, None, False), (5, 9, True), (500, None, False), (50_000, None, False), (50_000, 9, True), (None, None, None)]
    df = spark.createDataFrame(grid, "c long, a long, f boolean")
    got = [(r.p.among, r.p.reason) for r in df.select(P.candidate_policy(F.col("c"), F.col("a"), F.col("f")).alias("p")).collect()]
    assert got == [("all", "noCandidates"), ("allowed", "filtersActiveAllowedIdx"), ("nothing", "noCandidates"), ("all", "tooSmallNoFilters"), ("allowed", "filtersActiveAllowedIdx"), ("candidates", "ok"), ("all", "tooLarge"), ("candidates", "tooLarge"), ("all", "noCandidates")]
    branches = spark.createDataFrame([("main",), ("dev",), (None,)], "b string")
    assert [r.x for r in branches.select(P.branch_allows("main", F.col("b")).alias("x")).collect()] == [True, False, False]


def test_rerank_budget(spark):
    rows = [(["a"], 31, 10.0, 5.0, 0), (list("abcdefgh"), 30, 1.0, 1.0, 0), (["a", "a"], 9, 1.0, 1.0, 0), (["a", "a", "a", "a"], 9, 1.0, 1.0, 0), (["-->", "-->"], 31, 10.0, 5.0, 0), ([], 0, None, None, None)]
    df = spark.createDataFrame(rows, "t array<string>, h int, a double, b double, d int")
    got = [(r.x.slack, r.x.reason) for r in df.select(P.rerank_budget(P.query_signals(F.col("t")), F.col("h"), F.col("a"), F.col("b"), F.col("d")).alias("x")).collect()]
    assert got == [(4, "high_confidence_low_entropy"), (9, "high_entropy_or_low_confidence"), (6, "moderate_confidence_short_query"), (8, "baseline"), (9, "high_entropy_or_low_confidence"), (9, "high_entropy_or_low_confidence")]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    df = lambda n: spark.range(n)
    ids = [s.create(df(i), f"n{i}") for i in range(5)]
    s.freeze(ids[0])
    s.tag(ids[1], "t")
    s.tag(ids[2], "t")
    assert s.read("tag:t").count() == 2 and s.read("latest").count() == 4 and s.read(f"snap:{ids[3]}").count() == 3 and s.read("build:0").count() == 0 and s.resolve("path:/x") == "/x"
    assert s.prune(1) == [ids[3], ids[1]]
    with pytest.raises(KeyError):
        s.resolve(f"snap:{ids[1]}")
    with pytest.raises(KeyError):
        s.resolve("what:ever")
    assert Snapshots(spark, str(tmp_path / "none")).registry().count() == 0


def test_generated_queries_depend_on_the_seed_alone(spark):
    rows = lambda seed, n=40: [tuple(r) for r in generated_queries(spark, n, seed, ["a", "b"]).orderBy("n").collect()]
    assert rows(3) == rows(3) != rows(4) and rows(3, 10) == rows(3)[:10] and {r[1] for r in rows(3, 200)} == {"term", "phrase", "both", "either", "path"}


def cut_words(word, words):
    """Every way to cut a word at once: the most characters in words of the dictionary, by trying all."""
    best = 0
    n = len(word)
    covered = [0] * (n + 1)
    for j in range(1, n + 1):
        covered[j] = max(covered[i] + (j - i if word[i:j] in words else 0) for i in range(j))
    best = covered[n]
    return best


def test_segmentation_of_the_vocabulary_covers_the_most(spark, sf_dir):
    import __spark_entry__ as entry
    from quernstone.queries.build import WORDS

    words = set(WORDS)
    for name in ("t04_dictionary_segmentation", "t05_expanded_tokens"):
        rows = entry.queries()[name](spark, sf_dir).collect()
        assert len(rows) == len({r[0] for r in rows}) > 100
        for token, parts in map(tuple, rows):
            parts = parts.split(" ") if parts else []
            assert "".join(parts) == token
            if name.startswith("t05") and (len(token) <= 3 or token in words):
                assert parts == [token]
            elif len(token) <= 32:
                assert sum(len(p) for p in parts if p in words) == cut_words(token, words), token


def test_stems_of_the_vocabulary(spark, sf_dir):
    import __spark_entry__ as entry

    rows = [tuple(r) for r in entry.queries()["t06_stems"](spark, sf_dir).collect()]
    assert len(rows) > 100
    for token, found in rows:
        assert found == stem_token(token) and len(found) <= len(token) + 1


def test_pieces_and_segments_of_whole_tables(spark, sf_dir):
    import __spark_entry__ as entry
    from quernstone.operators.chunking import _slow_cuts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()}
    want = set()
    for k, text in docs.items():
        start = piece = 0
        while start < len(text):
            end, size = start, 0
            while end < len(text) and (size + len(text[end].encode()) <= 256 or end == start):
                size += len(text[end].encode())
                end += 1
            want.add((k, piece, start, end, size))
            start, piece = end, piece + 1
    assert {tuple(r) for r in entry.queries()["t20_split_by_bytes"](spark, sf_dir).collect()} == want
    from quernstone.operators import tables

    files = {r.file_id: r.content for r in tables.files(spark, sf_dir, "content").filter("content is not null").collect()}
    mask = (1 << 9) - 1
    want = {(k, n, a, b) for k, text in files.items() for n, (a, b) in enumerate(_slow_cuts(text, 128, 2048, mask))}
    assert {tuple(r) for r in entry.queries()["t24_content_defined_segments"](spark, sf_dir).collect()} == want


def test_normal_texts_and_taint_of_whole_tables(spark, sf_dir):
    import re
    import unicodedata

    import __spark_entry__ as entry
    from quernstone.operators import tables
    from quernstone.queries.build import RISK_RULES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in entry.queries()["x10_normal_text"](spark, sf_dir).collect()}
    assert got == {k: t if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for k, t in docs.items()}

    def flows(text):
        """Taint by its definition, a name at a time."""
        tainted, out = {}, []
        for n, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if not line or line.startswith(("//", "#", "*", "/*")):
                continue
            hit = {r.id: r for r in RISK_RULES if re.search(r.pattern, line)}
            names = set(re.findall(r"[A-Za-z_$][\w$]*", line))
            cleans = any(r.kind == "sanitizer" for r in hit.values())
            if cleans:
                tainted = {k: v for k, v in tainted.items() if k not in names}
            sources = set() if cleans else {k for k, r in hit.items() if r.kind == "source"} | {s for k in names for s in tainted.get(k, ())}
            out += [(n, s, k) for k, r in hit.items() if r.kind == "sink" for s in sources]
            m = re.match(r"(?:(?:const|let|var)\s+)?([A-Za-z_$][\w$]*)\s*:?=(?![=>])\s*(.+)", line)
            if m and not any(x in line for x in ("==", "!=", ">=", "<=")):
                right = set(re.findall(r"[A-Za-z_$][\w$]*", m.group(2)))
                carried = set() if cleans else {k for k, r in hit.items() if r.kind == "source"} | {s for k in right for s in tainted.get(k, ())}
                if carried:
                    tainted[m.group(1)] = carried
                else:
                    tainted.pop(m.group(1), None)
        return out

    want = sorted((r.id, *f) for r in tables.located(spark, sf_dir).filter("text is not null").select("id", "text").collect() for f in flows(r.text))
    assert sorted((r.id, r.line, r.source, r.sink) for r in entry.queries()["g11_local_taint"](spark, sf_dir).collect()) == want and want

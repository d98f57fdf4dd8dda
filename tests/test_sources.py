import json

from pyspark.sql import functions as F

from quernstone.sources import files as S, symbols as Y
from quernstone.streaming import incremental as I


def test_ctags_and_gtags(spark, tmp_path):
    (tmp_path / "tags.jsonl").write_text('{"_type": "ptag", "name": "x"}\n{"_type": "tag", "name": "f", "path": "a.py", "kind": "function", "line": 3}\n{"_type": "tag", "path": "b"}\n')
    (tmp_path / "gtags.txt").write_text("main 12 src/a b.c\n\nbad line\n")
    assert [(r.file, r.name, r.line) for r in Y.ctags(spark, str(tmp_path / "tags.jsonl")).collect()] == [("a.py", "f", 3)]
    assert [(r.file, r.name, r.line) for r in Y.gtags(spark, str(tmp_path / "gtags.txt")).collect()] == [("src/a b.c", "main", 12)]


def test_lsif(spark, tmp_path):
    rows = [
        {"id": 1, "type": "vertex", "label": "document", "uri": "file:///a.ts"}, {"id": 2, "type": "vertex", "label": "range", "start": {"line": 4, "character": 0}, "end": {"line": 4, "character": 3}, "tag": {"text": "foo"}},
        {"id": 3, "type": "vertex", "label": "range", "start": {"line": 9, "character": 0}, "end": {"line": 9, "character": 3}, "tag": {"text": "foo"}}, {"id": 4, "type": "vertex", "label": "definitionResult"}, {"id": 5, "type": "vertex", "label": "referenceResult"},
        {"id": 6, "type": "edge", "label": "contains", "outV": 1, "inVs": [2, 3]}, {"id": 7, "type": "edge", "label": "item", "outV": 4, "inVs": [2]}, {"id": 8, "type": "edge", "label": "item", "outV": 5, "inV": 3}]
    (tmp_path / "dump").write_text("\n".join(map(json.dumps, rows)))
    assert {(r.file, r.name, r.role, r.line) for r in Y.lsif(spark, str(tmp_path / "dump")).collect()} == {("/a.ts", "foo", "definition", 5), ("/a.ts", "foo", "reference", 10)}


def test_lsif_items_from_ranges_to_results_with_plain_tags(spark, tmp_path):
    rows = [
        {"id": 11, "type": "vertex", "label": "document", "uri": "file:///w/src/b.go", "languageId": "go"}, {"id": 12, "type": "vertex", "label": "range", "start": {"line": 6, "character": 5}, "end": {"line": 6, "character": 9}, "tag": "Open"},
        {"id": 13, "type": "vertex", "label": "definitionResult"}, {"id": 14, "type": "vertex", "label": "referenceResult"}, {"id": 15, "type": "edge", "label": "contains", "outV": 11, "inVs": [12]},
        {"id": 16, "type": "edge", "label": "item", "outV": 12, "inVs": [13]}, {"id": 17, "type": "edge", "label": "item", "outV": 12, "inVs": [14]}]
    (tmp_path / "dump").write_text("\n".join(map(json.dumps, rows)))
    assert {tuple(r) for r in Y.lsif(spark, str(tmp_path / "dump")).collect()} == {("/w/src/b.go", "Open", "definition", 7), ("/w/src/b.go", "Open", "reference", 7)}


def test_scip(spark, tmp_path):
    doc = {"documents": [{"relativePath": "a.go", "language": "go", "symbols": [{"symbol": "s1", "displayName": "Run"}], "occurrences": [{"range": [0, 1, 2], "symbol": "s1", "symbolRoles": 1}, {"range": [5, 1, 2], "symbol": "s1", "symbolRoles": 8}, {"range": [6, 0, 1], "symbol": "s2", "symbolRoles": 3}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc, indent=1))
    assert {(r.symbol, r.name, r.role, r.line) for r in Y.scip(spark, str(tmp_path / "i.json")).collect()} == {("s1", "Run", "definition", 1), ("s1", "Run", "reference", 6), ("s2", None, "definition", 7)}


def test_structural(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"check_id": "r1", "path": "a.js", "start": {"line": 2}, "end": {"line": 3}, "extra": {"lines": "x"}}\n{"ruleId": "r2", "file": "b.js", "range": {"start": {"line": 7}, "end": {"line": 7}}, "text": "y"}\n{"x": 1}\n')
    assert {(r.rule, r.file, r.start_line, r.snippet) for r in Y.structural(spark, str(tmp_path / "m.jsonl")).collect()} == {("r1", "a.js", 2, "x"), ("r2", "b.js", 7, "y")}


def test_discovery_modes_and_binary(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("é" * 10)
    (tmp_path / "c.bin").write_bytes(b"\x00\x01\x02" * 10)
    f = S.discover(spark, str(tmp_path)).select("path", "size", S.mode(F.col("path")).alias("mode"), S.looks_binary(F.col("content")).alias("binary"), S.decoded(F.col("content"), 5).alias("text"))
    got = {r.path: r for r in f.collect()}
    assert set(got) == {"src/a.py", "b.md", "c.bin"} and got["b.md"].mode == "prose" and got["c.bin"].binary and not got["src/a.py"].binary
    assert got["b.md"].text == "éé" and got["src/a.py"].text == "x = 1"
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("y")
    routed = {r.path: (r.mode, r.skipped) for r in S.discover(spark, str(tmp_path), ["*.bin"]).drop("content").collect()}
    assert routed == {"src/a.py": ("code", None), "b.md": ("prose", None), "node_modules/x.js": ("code", "skipped_dir")}


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/b.log",), ("keep.log",), ("build/x",), ("src/build/x",), ("docs/a/t.md",), (None,)], "p string")
    got = [r.i for r in df.select(S.ignored(F.col("p"), ["*.log", "!keep.log", "/build/", "docs/**/*.md"]).alias("i")).collect()]
    assert got == [True, False, True, False, True, False]


def test_assembly_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "doc_id long, t string")
    assert sorted((r.doc_id, r.t) for r in S.assemble([a, a.limit(0), a]).collect())[-1][0] >= 3
    S.write_jsonl(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    S.compact(spark, write(a, tmp_path), str(tmp_path / "c"), 1)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert S.dot_lines(spark.createDataFrame([('a"b', "c")], "src string, dst string")).first()[0] == '  "a\\"b" -> "c";'


def write(df, tmp_path):
    df.repartition(4).write.parquet(str(tmp_path / "p"))
    return str(tmp_path / "p")


def test_stream_upserts_once(spark, tmp_path):
    schema = "k long, v string, ts long, deleted boolean"
    empty = spark.createDataFrame([], "k long, v string")
    sink = I.TableSink(spark, str(tmp_path / "t"), "k", empty)
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False)], schema).write.json(str(source / "d1"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(source))
        q = stream.writeStream.foreachBatch(sink.apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    assert sorted(map(tuple, sink.read().collect())) == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, None, 5, True), (3, "d", 5, False)], schema).write.json(str(source / "d2"))
    run()
    assert sorted(map(tuple, sink.read().collect())) == [(1, "b"), (3, "d")]
    sink.apply(spark.createDataFrame([(9, "z", 1, False)], schema), 0)
    assert sink.read().filter("k = 9").isEmpty()
    assert abs(I.change_ratio(sink.read(), spark.createDataFrame([(1, "x", 1, False)], schema), "k") - 0.5) < 1e-9


def test_windowed_stream_drops_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-01 00:59:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 1.0)]
    e = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = I.event_windows(s, "1 hour", "30 minutes").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_type, r.n, r.total) for r in spark.sql("select * from w").collect()] == [("a", 2, 3.0)]


def test_decoded_is_cut_at_whole_characters(spark):
    from quernstone.sources.files import decoded

    texts = ["", "abc", "aä€😀z" * 3, "€" * 5 + "\ufffd" * 3, "😀" * 4]
    contents = [t.encode() for t in texts] + [b"ab\xffcd\xffef", b"\xff\xff\xff\xff\xff", b"a\xe2\x82", "ä\n".encode() * 4]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k long, b binary")
    for cap in range(1, 14):
        got = {r.k: r.t for r in df.select("k", decoded(F.col("b"), cap).alias("t")).collect()}
        for k, c in enumerate(contents):
            end = cap
            while len(c) > cap and end and c[end] & 0xC0 == 0x80:
                end -= 1
            assert got[k] == c[:end].decode("utf-8", "replace"), (cap, c)


def test_every_content_is_decoded(spark, sf_dir, tmp_path):
    import __spark_entry__ as entry

    files = spark.read.parquet(f"{sf_dir}/files.parquet")
    long = files.filter("content is not null").orderBy("file_id").limit(1).withColumns({"file_id": F.lit(987654321).cast("long"), "path": F.lit("x/long.md"), "content": F.repeat(F.lit("é€ long\n"), 2000)})
    files.unionByName(long).coalesce(1).write.parquet(f"{tmp_path}/files.parquet")
    want = {r.file_id: len(r.content) for r in files.unionByName(long).filter("content is not null").collect()}
    assert {r.file_id: r.chars for r in entry.queries()["s06_decoded"](spark, str(tmp_path)).collect()} == want


def test_pieces_of_every_mode(spark, sf_dir, tmp_path):
    import __spark_entry__ as entry
    from quernstone.operators import tables

    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    chunks.withColumn("mode", F.when(F.col("id") % 10 != 0, F.col("mode"))).coalesce(1).write.parquet(f"{tmp_path}/chunks.parquet")
    kept = tables.chunks(spark, str(tmp_path), "mode").collect()
    modes = {r.mode for r in kept}
    assert {"code", "prose", "extracted-prose", None} <= modes
    order = ["code", "prose", *sorted(m for m in modes if m not in ("code", "prose", None)), None]
    want = list(enumerate(i for m in order for i in sorted(r.id for r in kept if r.mode == m)))
    assert sorted((r.doc_id, r.id) for r in entry.queries()["s20_piece_assembly"](spark, str(tmp_path)).collect()) == want


def test_job_queue_keeps_state_and_takes_back_stale_jobs(spark, tmp_path):
    import datetime as dt

    from quernstone.streaming.jobs import job_states, next_status

    t0 = dt.datetime(2024, 1, 1)
    kind = "job string, event string, ts timestamp"

    def put(name, rows):
        spark.createDataFrame([(j, e, t0 + dt.timedelta(minutes=m)) for j, e, m in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = (job_states(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
             .foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).start())
        q.awaitTermination()

    put("a", [("a", "enqueue", 0), ("a", "claim", 1), ("a", "complete", 3), ("b", "enqueue", 0), ("b", "claim", 1), ("c", "claim", 1), ("d", "enqueue", 0), ("d", "claim", 1), ("d", "fail", 2), (None, "claim", 1)])
    run()
    put("b", [("e", "enqueue", 60), ("a", "claim", 61), ("d", "claim", 60)])
    run()
    put("c", [("e", "claim", 62)])
    run()
    last = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.at_ms, r.attempts)):
        last[r.job] = (r.status, r.attempts)
    assert last["a"] == ("done", 1) and last["b"] == ("queued", 1) and "c" not in last and last["d"][1] == 2 and last["e"] == ("running", 1)
    assert next_status("running", 3, "fail", 2) == ("failed", 3) and next_status("done", 1, "claim", 2) == ("done", 1) and next_status(None, 0, "claim", 2) == (None, 0)


def test_logs_and_blame_of_version_control(spark, tmp_path):
    from quernstone.sources import vcs

    text = "\x1ea1\x1fAda\x1f2024-01-02T03:04:05+00:00\n\n3\t1\tsrc/a b.py\n-\t-\tx.png\n\x1eb2\x1fBo\x1f2024-01-03T00:00:00+01:00\n\n0\t2\tsrc/a b.py\n\x1ec3\x1fBo\x1fno date\n\x1ebroken\n"
    (tmp_path / "log").write_text(text)
    got = {r.path: (r.commits, r.churn, r.authors, r.last_author) for r in vcs.history(vcs.log(spark, str(tmp_path / "log"))).collect()}
    assert got == {"src/a b.py": (2, 6, 2, "Bo"), "x.png": (1, 0, 1, "Ada")}
    (tmp_path / "blame").write_text("a.py\t1\t3\tAda\na.py\t4\t0\tBo\nbad\n\na.py\t4\t2\tCy D\n")
    assert {tuple(r) for r in vcs.blame(spark, str(tmp_path / "blame")).collect()} == {("a.py", "Ada", 1, 3), ("a.py", "Cy D", 4, 5)}

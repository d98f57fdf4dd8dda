from quernstone.llm.handwritten import classify, header_of, looks_data, looks_minified

FILES = "file_id long, repo string, path string, content string, extra string, reasons string, digest string"


def reasons(spark, *rows):
    df = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(rows)], FILES)
    return {r.file_id: set(r.reasons) for r in classify(df).collect()}


def test_notices_and_their_denials(spark):
    got = reasons(
        spark, ("r", "a.go", "// Code generated by x v1. DO NOT EDIT.\npackage a\n"), ("r", "a.py", "# Prints the DO NOT EDIT banner into files it writes.\nx = 1\n"),
        ("r", "b.py", "# This used to be generated; it has been maintained by hand since.\nx = 1\n"), ("r", "c.js", "/*\n * Diese Datei wurde automatisch erzeugt. Nicht bearbeiten!\n */\nf();\n"),
        ("r", "d.js", "f();\n// Code generated by x. DO NOT EDIT.\n"), ("r", "e.rs", "/// Vendored copy of y 1.2; report bugs to the y project.\nfn f() {}\n"))
    assert got[0] == got[3] == got[5] == {"notice"}
    assert not got[1] and not got[2] and not got[4]


def test_paths(spark):
    got = reasons(
        spark, ("r", "web/node_modules/a/b.js", "f()"), ("r", "src\\vendor_portal\\b.js", "f()"), ("r", "public/js/x.120m-min.js", "f()"), ("r", "a/deps.lock-1.json", "{}"),
        ("r", "tools/minify/a.ts", "f()"), ("r", "a/b.generated.ts", "f()"), ("r", "src/lock.py", "x"), ("r", None, None), ("r", "third_party/a/b.c", ""))
    assert got == {0: {"vendor_path"}, 1: set(), 2: {"minified_name"}, 3: {"lock"}, 4: set(), 5: {"generated_name"}, 6: set(), 7: set(), 8: {"vendor_path"}}


def test_copies_in_several_repos(spark):
    text = "def f():\n    " + "value = compute(1)\n    " * 10
    got = reasons(spark, ("r", "a.py", text), ("s", "b.py", text.replace("\n", "\r\n")), ("r", "c.py", ""), ("s", "d.py", ""), ("r", "e.py", text + "x"), ("r", "f.py", text + "x"))
    assert got == {0: {"copy"}, 1: {"copy"}, 2: set(), 3: set(), 4: set(), 5: set()}


def test_figures():
    assert looks_data("export const a = [\n" + "  0x11, 0x22, 0x33,\n" * 60 + "];\n")
    assert looks_data('A = "' + "QUJD" * 400)
    assert not looks_data("const x = [1, 2, 3];\n" * 60)
    assert looks_minified("function a(b){return b?c(b,1):void 0}" * 30)
    assert not looks_minified("// " + "long words in a comment " * 40)


def test_figures_hold_for_short_texts_too():
    assert looks_minified("function a(b){return b?c(b,1):void 0}var d=a(1);export{a as f,d as g};if(d){d();a(2)}")
    for hand in ("export default x;", "for (;;) { x++; }", "f();\n", "const a = 1; const b = 2;\nf(a, b);\n", ""):
        assert not looks_minified(hand), hand
    assert looks_data("[" + ",".join(str(i) for i in range(100, 140)) + "]") and not looks_data("[1, 2, 3]") and not looks_data("")


def test_short_copies_and_foreign_banners(spark):
    got = reasons(spark, ("r", "a.js", "export * from 'x';"), ("s", "b.js", "export * from  'x';\n"), ("r", "c.js", "{}"), ("s", "d.js", "{ }"), (None, "e.js", "f(1)"), ("r", "f.js", "f(1)"),
                  ("r", "g.py", "# vexil.js | (c) The Vexil Authors | released under the BSD licence\nx = 1\n"), ("r", "h.py", "# Copyright (c) 2030 the r contributors. Licensed under the MIT licence.\nx = 2\n"),
                  ("r", "i.go", "// Imported verbatim from the wob source tree at rev 6f28de34\npackage a\n"))
    assert got == {0: {"copy"}, 1: {"copy"}, 2: set(), 3: set(), 4: set(), 5: set(), 6: {"notice"}, 7: set(), 8: {"notice"}}


def test_header_ends_at_code_and_survives_odd_texts():
    assert header_of("#!/bin/sh\n# A\nx\n# B") == "#!/bin/sh\n# a"
    assert header_of("") == "" and header_of("/* never closed") == "/* never closed"


def test_empty_table(spark):
    assert classify(spark.createDataFrame([], FILES)).count() == 0

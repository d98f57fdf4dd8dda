from quernstone.llm.documentation import class_head, clean_lines, comment_above, documentation_in, documented, imported_from, pairs, python_docstring, tells
from tests.conftest import write_tables

CHUNKS = ("id long, mode string, repo string, file_id long, file string, start long, `end` long, kind string, name string, "
          "docmeta struct<doc:string,signature:string,params:array<string>,returnType:string,returns:boolean>")
FILES = "file_id long, repo string, path string, content string, ingested_at timestamp"


def test_what_tells_something():
    for doc in ("Sorted by hop, then id.", "/** Never blocks the caller. */", "@param x the largest size in bytes", "Gibt das erste Ergebnis zurueck.", ":return: bytes that were not yet flushed"):
        assert tells(doc, "scan", ["x"]), doc


def test_what_tells_nothing():
    for doc in ("", "  ", "Helper.", "/** */", "TODO: document", "@param x\n@returns", "{@inheritDoc}", "noqa: E501", "# -----", "SPDX-License-Identifier: MIT", "Copyright (c) 2030 the x contributors.",
                "const old = scan(x, 3);", "The scan function", "see scanAll", "scan all (x)", "eslint-disable-next-line no-unused-vars", "Scans all.", "ScanAll function.", "return x.y + 3;"):
        assert not tells(doc, "scanAll", ["x"]), doc
    assert not tells(None, None, None)


def test_comment_must_stand_right_above():
    assert comment_above("// Far off.\n\nfunction f() {}", False) is None
    assert comment_above("/**\n * Near.\n */\nfunction f() {}", False) == "/**\n* Near.\n*/"
    assert comment_above("// Near\r\n#[inline]\r\nfn f() {}", False) == "// Near"
    assert comment_above("", False) is None


def test_docstrings():
    assert python_docstring('def f(a, b=":"):\n    """Says it."""\n    return 1') == "Says it."
    assert python_docstring("async def f(x: int) -> dict:\n    '''Cut off") == "Cut off"
    assert python_docstring("def f():\n    return 'x'") is None
    assert documentation_in("# Above.\ndef f():\n    pass", "py") == "# Above."


def test_class_heads():
    assert class_head("export class A extends b.B implements C<D>, E {") == ("A", ["B", "C", "E"])
    assert class_head("class A(Base, mixin.M, metaclass=X):") == ("A", ["Base", "M"])
    assert class_head("impl<T> Show for A<T> {") == ("A", ["Show"])


def test_inheritance_climbs_and_survives_cycles(spark, tmp_path):
    base = "class Root {\n  /** Reads the next record from disk. */\n  next() {}\n}\n"
    mid = "class Mid extends Root {\n  /** {@inheritDoc} */\n  next() {}\n}\n"
    leaf = "class Leaf extends Mid {\n  next() {}\n  other() {}\n}\n"
    loop = "class P extends Q {\n  m() {}\n}\nclass Q extends P {\n  m() {}\n}\n"
    texts = [base, mid, leaf, loop]
    files = [(i, "r", f"{i}.js", t, None) for i, t in enumerate(texts)]

    def at(i, part, id_, kind, name):
        start = texts[i].index(part)
        return (id_, "code", "r", i, f"{i}.js", start, start + len(part), kind, name, None)

    rows = [at(i, t, 100 + i, "ClassDeclaration", n) for i, (t, n) in enumerate(((base.strip(), "Root"), (mid.strip(), "Mid"), (leaf.strip(), "Leaf")))]
    rows += [at(0, "/** Reads the next record from disk. */\n  next() {}", 1, "MethodDefinition", "next"), at(1, "/** {@inheritDoc} */\n  next() {}", 2, "MethodDefinition", "next"),
             at(2, "next() {}", 3, "MethodDefinition", "next"), at(2, "other() {}", 4, "MethodDefinition", "other")]
    first = loop.index("class Q")
    rows += [(104, "code", "r", 3, "3.js", 0, first, "ClassDeclaration", "P", None), (105, "code", "r", 3, "3.js", first, len(loop), "ClassDeclaration", "Q", None), at(3, "m() {}", 6, "MethodDefinition", "m")]
    rows += rows[-1:]
    folder = write_tables(spark, tmp_path, chunks=(rows, CHUNKS), files=(files, FILES))
    got = {r.id: r.source for r in documented(spark, folder).collect()}
    assert got == {1: "text", 2: "inherited", 3: "inherited"}


def test_docmeta_first_and_nulls(spark, tmp_path):
    text = "// Rounds half up toward infinity.\nfunction f() {}\n"
    meta = ("Helper.", None, None, None, None)
    rows = [(1, "code", "r", 1, "a.js", 0, 60, "function", "f", meta), (2, "code", "r", 1, "a.js", 0, 60, "function", "f", ("  ", None, None, None, None)), (3, "code", "r", None, None, None, None, "func", None, None),
            (4, "code", "r", 1, "a.js", 0, 60, None, "f", None), (None, "code", "r", 1, "a.js", 0, 60, "fn", "f", None)]
    folder = write_tables(spark, tmp_path, chunks=(rows, CHUNKS), files=([(1, "r", "a.js", text, None)], FILES))
    assert [r.id for r in documented(spark, folder).collect()] == [2]


def test_empty(spark, tmp_path):
    folder = write_tables(spark, tmp_path, chunks=([], CHUNKS), files=([], FILES))
    assert documented(spark, folder).count() == 0


def test_heads_of_traits_and_embedded_types():
    assert class_head("pub trait Walk: Show + fmt::Debug + Iterator<Item = u8> where Self: Sized {") == ("Walk", ["Show", "Debug", "Iterator"])
    assert class_head("type Tree struct {\n\tNode\n\t*pkg.Leaf `json:\"x\"`\n\tname string\n\tf, g int\n}") == ("Tree", ["Node", "Leaf"])
    assert class_head("type Reader interface {\n\tCloser\n\tRead(p []byte) error\n}") == ("Reader", ["Closer"])
    assert class_head("type ID int") == (None, [])


def test_imports_of_a_name():
    assert imported_from("import { Base as B, Other } from '../core/base';\n", "Base", "src/x/a.ts")[:2] == ["src/core/base", "src/core/base.ts"]
    assert imported_from("import { Base } from 'lib';\nimport { Other } from './o';\n", "Base", "src/a.js") == []
    assert imported_from("from ..core.base import (\n  Base,\n)\n", "Base", "src/x/a.py") == ["src/core/base.py", "src/core/base/__init__.py"]
    assert "src/core/base.py" in imported_from("from core.base import Base\n", "Base", "src/x/a.py")
    assert "src/core/base.rs" in imported_from("use crate::core::base::{Base, Other};\n", "Base", "src/x.rs")


def _planted(files, chunks):
    """Rows of files and of the chunks that begin and end with given texts."""
    texts = {path: text for _, path, text in files}
    ids = {path: i for i, path, _ in files}
    rows = []
    for id_, path, part, kind, name in chunks:
        start = texts[path].index(part)
        rows.append((id_, "code", "r", ids[path], path, start, start + len(part), kind, name, None))
    return [(i, "r", p, t, None) for i, p, t in files], rows


def test_bases_are_found_by_file_and_import(spark, tmp_path):
    one = "export class Base {\n  /** Reads the next record from disk. */\n  next() {}\n}\n"
    two = "export class Base {\n  /** Paints a border around the widget. */\n  next() {}\n}\n"
    user = "import { Base } from '../b/base';\nclass Leaf extends Base {\n  next() {}\n}\n"
    lost = "class Stray extends Base {\n  next() {}\n}\n"
    go = "package a\n\ntype Node struct {\n\tid int\n}\n\n// Returns the bytes that the node holds on disk.\nfunc (n *Node) Size() int { return 1 }\n"
    go2 = "package a\n\ntype Tree struct {\n\tNode\n\tx int\n}\n\nfunc (t *Tree) Size() int { return 2 }\n"
    rs = "trait Show {\n    /// Writes the value as one line of text.\n    fn show(&self);\n}\ntrait Walk: Show {\n    fn walk(&self);\n}\nimpl Walk for A {\n    fn show(&self) { }\n}\n"
    nested = "class Outer {\n  a() {}\n  static Inner = class Deep extends Outer {\n    a() {}\n  }\n}\n"
    files, rows = _planted(
        [(1, "a/base.js", one), (2, "b/base.js", two), (3, "c/leaf.js", user), (4, "d/stray.js", lost), (5, "g/node.go", go), (6, "g/tree.go", go2), (7, "r/a.rs", rs), (8, "n/n.js", nested)],
        [(101, "a/base.js", one.strip(), "ClassDeclaration", "Base"), (102, "b/base.js", two.strip(), "ClassDeclaration", "Base"), (103, "c/leaf.js", user[user.index("class") :].strip(), "ClassDeclaration", "Leaf"),
         (104, "d/stray.js", lost.strip(), "ClassDeclaration", "Stray"), (105, "g/node.go", "type Node struct {\n\tid int\n}", "StructDeclaration", "Node"), (106, "g/tree.go", "type Tree struct {\n\tNode\n\tx int\n}", "StructDeclaration", "Tree"),
         (107, "r/a.rs", rs[: rs.index("trait Walk")].strip(), "trait", "Show"), (108, "r/a.rs", rs[rs.index("trait Walk") : rs.index("impl")].strip(), "trait", "Walk"), (109, "r/a.rs", rs[rs.index("impl") :].strip(), "impl", "A"),
         (1, "a/base.js", "/** Reads the next record from disk. */\n  next() {}", "MethodDefinition", "next"), (2, "b/base.js", "/** Paints a border around the widget. */\n  next() {}", "MethodDefinition", "next"),
         (3, "c/leaf.js", "next() {}", "MethodDefinition", "next"), (4, "d/stray.js", "next() {}", "MethodDefinition", "next"),
         (5, "g/node.go", "// Returns the bytes that the node holds on disk.\nfunc (n *Node) Size() int { return 1 }", "MethodDeclaration", "Size"), (6, "g/tree.go", "func (t *Tree) Size() int { return 2 }", "MethodDeclaration", "Size"),
         (7, "r/a.rs", "/// Writes the value as one line of text.\n    fn show(&self);", "fn", "show"), (8, "r/a.rs", "fn show(&self) { }", "fn", "show"), (9, "n/n.js", "a() {}", "MethodDefinition", "a")])
    folder = write_tables(spark, tmp_path, chunks=(rows, CHUNKS), files=(files, FILES))
    got = {r.id: (r.source, clean_lines(r.doc)[0], r.code) for r in pairs(spark, folder).collect()}
    assert {i: s for i, (s, _, _) in got.items()} == {1: "text", 2: "text", 3: "inherited", 5: "text", 6: "inherited", 7: "text", 8: "inherited"}
    # of two types of one name the imported one lends its documentation, and none where nothing tells which is meant
    assert got[3][1] == "Paints a border around the widget." and got[6][1].startswith("Returns the bytes") and got[8][1].startswith("Writes the value")
    assert got[6][2] == "func (t *Tree) Size() int { return 2 }" and got[1][2].endswith("next() {}")


def test_found_takes_what_a_tag_asks_to_inherit(spark, tmp_path):
    from quernstone.llm.queries import QUERIES

    base = "class Root {\n  /** Reads the next record from disk. */\n  next() {}\n}\n"
    asks = "class Mid extends Root {\n  /** {@inheritDoc} */\n  next() {}\n}\n"
    bare = "class Low extends Root {\n  next() {}\n}\n"
    files, rows = _planted([(1, "a.js", base + asks + bare)], [
        (11, "a.js", base.strip(), "ClassDeclaration", "Root"), (12, "a.js", asks.strip(), "ClassDeclaration", "Mid"), (13, "a.js", bare.strip(), "ClassDeclaration", "Low"),
        (1, "a.js", "/** Reads the next record from disk. */\n  next() {}", "MethodDefinition", "next"), (2, "a.js", "/** {@inheritDoc} */\n  next() {}", "MethodDefinition", "next")])
    start = (base + asks).__len__() + bare.index("next")
    rows.append((3, "code", "r", 1, "a.js", start, start + 9, "MethodDefinition", "next", None))
    folder = write_tables(spark, tmp_path, chunks=(rows, CHUNKS), files=(files, FILES))
    assert {r.id for r in QUERIES["p3_pairs"](spark, folder).collect()} == {1, 2, 3}
    assert {r.id for r in QUERIES["p3_found"](spark, folder).collect()} == {1, 2}

"""Functions and methods paired with their documentation.

Own documentation is docmeta.doc or, where that is missing, the comment above the declaration or the docstring in the chunk's text.
A method without any, or with a tag that asks to inherit, takes the documentation of the method it overrides: classes, their
bases and their methods are tables, and the search goes up the hierarchy one level in each join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.llm.chunktext import files_with_chunks, with_file_id
from quernstone.runtime import cut, table

# Kinds of chunks that are functions or types.
FUNCTION_KINDS = r"(?i)function|method|^(?:func|fn|def|sub|procedure|proc|constructor|getter|setter|accessor)$"
CLASS_KINDS = r"(?i)class|interface|trait|^impl|struct"

# Whole remarks that tell nothing, lower-case and without punctuation at the ends.
PLACEHOLDERS = re.compile(
    r"(?:n/?a|none|null|nil|tbd|tba|wip|xxx+|placeholder|description|docs?|documentation|comment|summary|undocumented|obvious|trivial|ditto"
    r"|self[- ]explanatory|same as (?:before|above)|see (?:above|below|code|source)|as above|(?:a |an |the )?(?:small |simple |little |internal |private |public )?(?:helper|utility|util|wrapper|getter|setter|constructor|callback|handler|stub|internal|implementation)(?: function| method| class| here)?"
    r"|(?:a |the )?(?:internal |private |public )?(?:function|method)(?: implementation| body| description)?|default constructor"
    r"|(?:no|missing|add(?: a)?|insert|write|needs?|todo|some|short|your) (?:description|documentation|docs?|comments?)(?: here| provided| available| yet| goes here)?(?: provided)?"
    r"|description (?:goes )?here|auto-?generated (?:method |function )?stub|not documented|lorem ipsum.*|(?:the )?(?:\w+ ){1,5}(?:function|method)|(?:function|method) \w+\(\)|does (?:stuff|things|something|what it says)|magic)"
)
_TODO = re.compile(r"(?i)(?:todo|fixme|hack|xxx|wip|tbd)\b")
_DIRECTIVE = re.compile(
    r"(?i)(?:noqa|pylint|eslint|tslint|jshint|jslint|jscs|prettier-ignore|istanbul|c8 ignore|v8 ignore|nolint|nosec|nosonar|fmt\s*:\s*(?:off|on|skip)|yapf|isort|flake8|mypy"
    r"|type\s*:\s*ignore|pyright|pragma|clang-format|clang-tidy|rustfmt|clippy|@ts-|@formatter|codecov|coverage\s*:|go:(?:build|generate|embed|no\w+|linkname)|\+build|webpack\w+\s*:|biome-ignore|stylelint|sourcemappingurl|vim?\s*:|-\*-)"
)
_LICENCE = re.compile(
    r"(?i)spdx-licen[sc]e|copyright\s*(?:\(c\)|©|\d{4})|\(c\)\s*(?:copyright\s*)?\d{4}|licen[sc]ed under|all rights reserved|this file is part of|permission is hereby granted|without warrant|without any warrant|redistribution and use|terms found in the licen[sc]e"
)
_CODE = re.compile(
    r"(?:.*[;{}]\s*$)|(?:(?:const|let|var|return|if|for|while|print|import|from|def|fn|func|function|elif|else|try|assert|yield|await|del|raise|throw|use|package|switch|case)\b.*[(=;{\[].*)"
    r"|(?:return\s+[\w.]+(?:\s*[-+*/.%(\[].*)?$)|(?:[\w.\[\]]+\s*(?::\s*\w+\s*)?[-+*/|&]?:?=\s*\S.*)|(?:[\w.]+\([^()]*\)\s*;?$)|(?:.*=>.*)"
)
_TAG = re.compile(
    r"(?:[@\\](?P<at>[\w-]+)|:(?P<colon>param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|yields?)\b)\s*:?\s*(?P<type>\{[^}]*\})?(?P<rest>.*)", re.S)
_NAMED_TAGS = frozenset("param parameter arg argument key keyword property prop tparam template type raises raise throws exception".split())
_INHERIT = re.compile(r"(?i)\{?@inherit_?doc\}?|:inherit_?doc|\{@inheritdoc\}")
_EDGES = " \t/*#!;<>\"'`-.:?,…"
# Words that say nothing about one function rather than another.
_STOP = frozenset(
    "a an the of to for in on at by with and or is are be was this that these those it its as from into if then than so function functions method methods class constructor "
    "helper utility see fn func def returns return gets get sets set does do param params parameter parameters argument arguments arg args value values object type types void "
    "implementation implements code here documentation doc docs description der die das le la les el los un une ein eine de du des et und y".split()
)


def _stem(word: str) -> str:
    for end in ("ings", "ing", "ied", "ies", "ed", "es", "s", "e", "er"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def _words(text: str) -> list[str]:
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    return [_stem(w.lower()) for w in re.findall(r"[^\W\d_]+", text)]


# Comment markers before and after the text of a line.
_OPENERS = re.compile(r"\s*(?:(?:/\*+!?|\*+/|//+!?|#+!?|\*+(?=\s|$)|\*|;;+|--+(?=\s|$)|[rRuUbB]?\"\"\"|'''|<!--|@\*)\s*)*")
_CLOSERS = ("*/", '"""', "'''", "-->")


def clean_lines(doc: str) -> list[str]:
    """Lines of a documentation text without comment markers; blank ones stay as ''."""
    lines = []
    for line in re.split(r"\r\n?|\n", doc):
        m = _OPENERS.match(line)
        start, end = m.end(), len(line)
        while True:
            while end > start and line[end - 1].isspace():
                end -= 1
            closer = next((c for c in _CLOSERS if line.endswith(c, start, end)), None)
            if closer is None:
                break
            end -= len(closer)
            while closer == "*/" and end > start and line[end - 1] == "*":
                end -= 1
        lines.append(line[start:end])
    return lines


def telling_words(doc: str, name: str | None, params: list[str] | None) -> int:
    """Distinct words of a documentation text that say something which name and parameters do not."""
    known = set(_words(name or ""))
    for p in params or []:
        known.update(_words(p or ""))
    found = set()
    for line in clean_lines(doc):
        if not re.search(r"[^\W_]", line) or _DIRECTIVE.match(line) or _LICENCE.search(line) or _TODO.match(line):
            continue
        line = _INHERIT.sub(" ", line)
        tag = _TAG.match(line)
        if tag:
            line = tag.group("rest").strip()
            word = (tag.group("at") or tag.group("colon") or "").lower()
            if word in _NAMED_TAGS:
                first = re.match(r"(\[?[\w.$*&]+\]?)\s*:?\s*[-:]*\s*(.*)", line, re.S)
                if first:
                    known.update(_words(first.group(1)))
                    line = first.group(2)
            elif word in ("author", "since", "version", "date", "file", "license", "licence", "copyright", "module", "namespace", "memberof", "name", "function", "method", "class", "see"):
                continue
        bare = line.strip(_EDGES).lower()
        if not bare or PLACEHOLDERS.fullmatch(bare) or (not tag and _CODE.fullmatch(line.strip())):
            continue
        for w in _words(line):
            if w not in known and w not in _STOP and (len(w) > 1 or ord(w) > 0x2E7F):
                found.add(w)
                if ord(w[0]) > 0x2E7F and len(w) > 3:
                    found.add(w[:-1])  # a run of ideographs is more than one word
    stopped = {_stem(w) for w in _STOP}
    return len(found - stopped)


ENOUGH = 2  # telling words from which documentation is worth having


def tells(doc: str | None, name: str | None, params: list[str] | None) -> bool:
    return bool(doc) and telling_words(doc, name, params) >= ENOUGH


_DECLARES = re.compile(r"\s*(?:async\s+def|def|class)\b")


def python_docstring(text: str) -> str | None:
    """The docstring of the first definition in a text; its end may be cut off."""
    m = re.search(r"^[ \t]*(?:async[ \t]+def|def|class)\b", text, re.M)
    if not m:
        return None
    depth, i, n = 0, m.end(), len(text)
    while i < n:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            break
        elif c in "\"'":
            j = text.find(c, i + 1)
            i = n if j < 0 else j
        elif c == "#":
            j = text.find("\n", i)
            i = n if j < 0 else j
        i += 1
    s = re.compile(r"(?:[ \t]*(?:#[^\r\n]*)?[\r\n]+)*[ \t]*[rRuU]?(\"\"\"|'''|\"|')").match(text, i + 1)
    if not s:
        return None
    quote = s.group(1)
    end = text.find(quote, s.end())
    if len(quote) == 1:
        line = text.find("\n", s.end())
        if end < 0 or 0 <= line < end:
            return None
    return text[s.end() : end if end >= 0 else n]


def comment_above(text: str, hash_comments: bool) -> str | None:
    """The comment that ends on the line right above the first declaration in a text."""
    held: list[str] = []
    inside = False
    for line in re.split(r"\r\n?|\n", text):
        bare = line.strip()
        if inside:
            held.append(bare)
            inside = "*/" not in bare
            continue
        if not bare:
            held = []
        elif hash_comments and bare.startswith("#"):
            held.append(bare)
        elif not hash_comments and bare.startswith("//"):
            held.append(bare)
        elif not hash_comments and bare.startswith("/*"):
            held.append(bare)
            close = bare.find("*/", 2)
            if close < 0:
                inside = True
            elif bare[close + 2 :].strip():
                return bare[: close + 2]  # the declaration follows on the same line
        elif bare.startswith("@") or (not hash_comments and re.match(r"#!?\[", bare)):
            continue  # decorators and attributes stand between a comment and its declaration
        else:
            break
    return "\n".join(held) if held else None


def documentation_in(text: str, ext: str) -> str | None:
    """The documentation a chunk's own text holds."""
    if ext in ("py", "pyi"):
        inner, above = python_docstring(text), comment_above(text, True)
        return "\n".join(x for x in (inner, above) if x) or None
    return comment_above(text, ext in ("sh", "rb", "pl", "r", "yml", "yaml", "toml"))


_NAMED = re.compile(r"\b(?:function\*?|def|fn|func(?:\s*\([^)]*\))?|const|let|var)\s+(\w+)")


def declared_name(text: str) -> str | None:
    """The name that the first declaration in a text gives."""
    m = _NAMED.search(re.sub(r"/\*.*?\*/|//[^\n]*|^\s*#[^\n]*", "", text, flags=re.S | re.M))
    return m.group(1) if m else None


# Heads of types with what they extend: groups name, a (one base) and b (a list).
_CLASS_HEAD = [
    re.compile(r"\bclass\s+(?P<name>\w+)\s*(?:<[^>{]*>)?\s*(?:extends\s+(?P<a>[\w.$]+)(?:<[^{]*?>)?)?\s*(?:implements\s+(?P<b>[^{]+))?\{"),
    re.compile(r"\binterface\s+(?P<name>\w+)\s*(?:<[^>{]*>)?\s*(?:extends\s+(?P<b>[^{]+))?\{"),
    re.compile(r"\bclass\s+(?P<name>\w+)\s*\((?P<b>[^()]*)\)\s*:"),
    re.compile(r"\bimpl\s*(?:<[^>]*>)?\s*(?P<a>[\w:]+)(?:<[^{]*?>)?\s+for\s+(?P<name>\w+)"),
    re.compile(r"\btrait\s+(?P<name>\w+)\s*(?:<[^>{]*>)?\s*(?::\s*(?P<b>[^{]+?))?\s*(?:where\b[^{]*)?\{"),
    re.compile(r"\btype\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?:struct|interface)\s*\{(?P<body>[^{}]*)"),
]
_EMBEDDED = re.compile(r"^[ \t]*\*?((?:\w+\.)?[A-Za-z_]\w*)(?:\[[^\]\n]*\])?[ \t]*(?:`[^`\n]*`)?[ \t]*(?://[^\n]*)?$", re.M)
_RECEIVER = re.compile(r"^\s*func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", re.M)


def class_head(text: str) -> tuple[str | None, list[str]]:
    """Name and bases of the first type in a text: superclasses, interfaces, traits of an implementation, supertraits, embedded types."""
    for form in _CLASS_HEAD:
        m = form.search(text)
        if m:
            groups = m.groupdict()
            if groups.get("body") is not None:
                named = _EMBEDDED.findall(groups["body"])
            else:
                named = [groups.get("a") or "", *re.split(r"[,+]", re.sub(r"<[^<>]*>", "", groups.get("b") or ""))]
            bases = [re.split(r"[.:]+", re.sub(r"<.*|\[.*", "", b).strip())[-1] for b in named if "=" not in b]
            return m.group("name"), [b for b in dict.fromkeys(bases) if re.fullmatch(r"\w+", b) and b not in ("object", "Object", "ABC") and b != m.group("name")]
    return None, []


_JS_IMPORT = re.compile(r"^\s*(?:import|export)\b([^;'\"]{0,4000}?)\bfrom\s*['\"]([^'\"\n]+)['\"]|^\s*(?:const|let|var)\s+([^=;\n]{1,400})=\s*require\(\s*['\"]([^'\"\n]+)['\"]", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+)", re.M)
_RS_IMPORT = re.compile(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)::(\{[^}]*\}|\w+)", re.M)


def _joined(folder: str, spec: str) -> str | None:
    """folder/spec without dots; None where it leaves the root."""
    out: list[str] = []
    for part in f"{folder}/{spec}".split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def imported_from(content: str, name: str, path: str) -> list[str]:
    """Paths of files from which a file may import a name, by its own statements: few, as only statements that give the name count."""
    folder, _, file = path.rpartition("/")
    ext = file.rpartition(".")[2].lower()
    has = re.compile(rf"\b{re.escape(name)}\b").search
    found: list[str | None] = []
    if ext in ("py", "pyi"):
        for module, names in _PY_IMPORT.findall(content):
            if has(names):
                bare = module.lstrip(".")
                dots = len(module) - len(bare)
                inner = bare.replace(".", "/")
                parts = folder.split("/") if folder else []
                roots = ["/".join(parts[: max(0, len(parts) - dots + 1)])] if dots else ["/".join(parts[:i]) for i in range(len(parts), -1, -1)]
                found += [_joined(r, f"{inner}{end}") for r in roots for end in (".py", "/__init__.py")]
    elif ext == "rs":
        for module, names in _RS_IMPORT.findall(content):
            if has(names):
                inner = re.sub(r"^(?:crate|self|super)(?:::|$)", "", module).replace("::", "/")
                parts = folder.split("/") if folder else []
                found += [_joined("/".join(parts[:i]), f"{inner}{end}") for i in range(len(parts), -1, -1) for end in (".rs", "/mod.rs")]
    else:
        for a, spec_a, b, spec_b in _JS_IMPORT.findall(content):
            spec = spec_a or spec_b
            if spec.startswith(".") and has(a or b):
                found += [_joined(folder, spec + end) for end in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")]
    return [f for f in dict.fromkeys(found) if f]


_BASES = ArrayType(StructType([StructField("base", StringType()), StructField("paths", ArrayType(StringType()))]))
_READ = StructType([
    StructField("id", LongType()), StructField("doc", StringType()), StructField("source", StringType()), StructField("tells", BooleanType()),
    StructField("class", StringType()), StructField("bases", _BASES), StructField("path", StringType()), StructField("receiver", StringType()),
])


def _read():
    def kernel(path, content, refs):
        path = re.sub(r"^(?:\.?/)+", "", (path or "").strip().replace("\\", "/"))
        ext = path.rpartition(".")[2].lower()
        for r in refs:
            start, end = r["start"], r["end"]
            text = content[max(0, start) : end] if start is not None and end is not None and end > start else ""
            if r["is_class"]:
                name, bases = class_head(text)
                yield r["id"], None, None, False, name or r["name"], [(b, imported_from(content, b, path)) for b in bases], path, None
            else:
                doc = documentation_in(text, ext)
                receiver = _RECEIVER.search(text) if ext == "go" else None
                yield r["id"], doc, "text", tells(doc, r["name"] or declared_name(text), r["params"]), None, None, None, receiver and receiver.group(1)
    return kernel


def _judge():
    def kernel(id_, name, params, doc, signature):
        receiver = _RECEIVER.match(signature or "")
        yield id_, doc, "docmeta", tells(doc, name, params), None, None, None, receiver and receiver.group(1)
    return kernel


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, files = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files")
    is_function, is_class = F.col("kind").rlike(FUNCTION_KINDS), F.col("kind").rlike(CLASS_KINDS)
    doc = F.col("docmeta.doc")
    picked = chunks.filter("id is not null").filter(is_function | is_class).select(
        "id", "repo", "file_id", "file", "start", "end", "kind", F.coalesce("name", "docmeta.signature").alias("name"), F.col("docmeta.params").alias("params"), F.col("docmeta.signature").alias("signature"),
        F.when(F.length(F.regexp_replace(doc, r"\s+", "")) > 0, doc).alias("doc"), (~is_function).alias("is_class"))
    given = map_rows(picked.filter("not is_class and doc is not null").select("id", "name", "params", "doc", "signature"), _judge, _READ)
    ref = F.struct("id", "name", "params", "start", "end", "is_class")
    texts = files_with_chunks(with_file_id(picked.filter("is_class or doc is null").drop("doc", "signature"), files), files, ref)
    read = map_rows(texts.select("path", "content", "refs"), _read, _READ)
    return given.unionByName(read)


def documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, doc, source, asked): function chunks with documentation worth having.

    source: docmeta, text (of the chunk) or inherited; asked: whether the chunk's own documentation asks to inherit. A chunk delivered again counts once, with docmeta before text; among
    different documentations of one source the least is taken. Chunks whose file is unknown or whose range is null or inverted have no
    text of their own.
    """
    own = cut(_functions(spark, sf_dir))
    meta = table(spark, sf_dir, "chunks").filter("id is not null").select("id", "repo", "file_id", "file", "start", "end", "kind", "name")
    best = own.filter("tells").groupBy("id").agg(F.min(F.struct("source", "doc")).alias("d")).select("id", "d.doc", "d.source", F.lit(False).alias("asked"))
    every = best.unionByName(_inherited(own, meta, table(spark, sf_dir, "files")))
    labels = meta.groupBy("id").agg(F.min(F.struct("name", "kind")).alias("m"))
    return every.join(labels, "id").select("id", "m.name", "m.kind", "doc", "source", "asked")


_CODE_OF = StructType([StructField("id", LongType()), StructField("code", StringType())])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, code, doc, source): code-description pairs. code is the chunk's range of its file; null where that is not known."""
    found = documented(spark, sf_dir).drop("asked")
    chunks, files = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files")
    places = with_file_id(chunks.filter("id is not null and end > start").select("id", "repo", "file_id", "file", "start", "end"), files)
    placed = places.join(found.select("id"), "id", "left_semi")

    def make():
        def kernel(content, refs):
            for r in refs:
                yield r["id"], content[max(0, r["start"]) : r["end"]]
        return kernel

    texts = files_with_chunks(placed, files, F.struct("id", "start", "end"))
    code = map_rows(texts.select("content", "refs"), make, _CODE_OF).groupBy("id").agg(F.min("code").alias("code"))
    return found.join(code, "id", "left").select("id", "name", "kind", "code", "doc", "source")


_HELD = StructType([StructField("id", LongType()), StructField("class", StringType())])


def _innermost():
    """Kernel over types and methods of a file in order of their start, the longer first: each method with the innermost type around it."""
    open_: list[tuple[int, str]] = []
    file = [None]

    def kernel(repo, file_id, start, end, name, id_):
        if file[0] != (repo, file_id):
            file[0] = repo, file_id
            open_.clear()
        while open_ and open_[-1][0] <= start:
            open_.pop()
        if id_ is None:
            open_.append((end, name))
        else:
            # types that end before the method does hold it not; those around them may
            holder = next((n for e, n in reversed(open_) if e >= end), None)
            if holder is not None:
                yield id_, holder
    return kernel


def _inherited(own: DataFrame, meta: DataFrame, files: DataFrame) -> DataFrame:
    """(id, doc, source, asked) of methods that take the documentation of a method they override.

    A base is the type of that name in the same file, else in a file that is imported for it, else the only one of that name in the folder, else in the repo;
    where several remain, none is taken. A method is held by its receiver's type, else by the innermost type around it.
    """
    spark = own.sparkSession
    empty = spark.createDataFrame([], "id long, doc string, source string, asked boolean")
    classes = own.filter("class is not null").select("id", "class", "bases", "path").distinct()
    if classes.filter(F.size("bases") > 0).isEmpty():
        return empty
    placed = cut(with_file_id(meta, files).filter("end > start").select("id", "repo", "file_id", "start", "end", "name").distinct())
    bodies = cut(classes.join(placed.drop("name"), "id").select("repo", "file_id", "class", "bases", "path", "start", "end", F.regexp_extract("path", "^(.*)/", 1).alias("folder")))
    judged = own.filter("class is null").groupBy("id").agg(
        F.max("tells").alias("tells"), F.min(F.when(F.col("tells"), F.col("doc"))).alias("doc"), F.max("receiver").alias("receiver"),
        F.coalesce(F.max(F.col("doc").rlike(_INHERIT.pattern)), F.lit(False)).alias("asked"), F.max(F.col("doc").isNull()).alias("bare"))
    methods = placed.filter("name is not null").join(judged, "id").withColumn("open", F.col("asked") | F.col("bare"))
    # types and methods of a file come sorted through one kernel: no pair of them is formed
    spans = bodies.select("repo", "file_id", "start", "end", F.col("class").alias("name"), F.lit(None).cast("long").alias("id")).unionByName(
        methods.filter("receiver is null").select("repo", "file_id", "start", "end", "name", "id"))
    ordered = spans.repartition("repo", "file_id").sortWithinPartitions("repo", "file_id", "start", F.desc("end"), F.asc_nulls_first("id"))
    around = map_rows(ordered.select("repo", "file_id", "start", "end", "name", "id"), _innermost, _HELD).groupBy("id").agg(F.min("class").alias("around"))
    inside = cut(
        methods.join(around, "id", "left").withColumn("class", F.coalesce("receiver", "around")).filter("class is not null")
        .select("id", "repo", "file_id", "class", "name", "tells", "doc", "open", "asked"))

    # where each base of a type is
    wanted = bodies.select("repo", "file_id", "folder", "class", F.explode("bases").alias("b")).select("repo", "file_id", "folder", "class", "b.base", "b.paths").distinct()
    known = bodies.select("repo", F.col("file_id").alias("base_file"), "folder", "path", F.col("class").alias("base")).distinct()
    same = known.select("repo", F.col("base_file").alias("file_id"), "base", F.col("base_file").alias("in_file")).distinct()
    by_path = known.groupBy("repo", "path", "base").agg(F.min("base_file").alias("at"))
    imported = (
        wanted.select("repo", "file_id", "class", "base", F.posexplode("paths").alias("rank", "path")).join(by_path, ["repo", "path", "base"])
        .groupBy("repo", "file_id", "class", "base").agg(F.min_by("at", "rank").alias("in_import")))
    only = lambda keys, out: known.groupBy(*keys, "base").agg(F.min("base_file").alias(out), F.count_distinct("base_file").alias("__n")).filter("__n = 1").drop("__n")
    up = cut(
        wanted.drop("paths").join(same, ["repo", "file_id", "base"], "left").join(imported, ["repo", "file_id", "class", "base"], "left")
        .join(only(["repo", "folder"], "in_folder"), ["repo", "folder", "base"], "left").join(only(["repo"], "in_repo"), ["repo", "base"], "left")
        .select("repo", "file_id", "class", "base", F.coalesce("in_file", "in_import", "in_folder", "in_repo").alias("base_file")).filter("base_file is not null").distinct())
    # a receiver names a type of its package: its methods may be in other files of the folder
    homes = known.select("repo", "base_file", "folder", "base").join(only(["repo", "folder"], "home"), ["repo", "folder", "base"]).select("repo", "folder", F.col("base").alias("class"), "home").distinct()
    folders = bodies.select("repo", "file_id", "folder").distinct().unionByName(
        files.filter("file_id is not null").select("repo", "file_id", F.regexp_extract(F.regexp_replace(F.trim("path"), r"\\", "/"), "^(.*)/", 1).alias("folder"))).distinct()
    here = known.select("repo", F.col("base_file").alias("file_id"), F.col("base").alias("class"), F.lit(True).alias("here")).distinct()
    homed = inside.join(folders, ["repo", "file_id"], "left").join(here, ["repo", "file_id", "class"], "left").join(homes, ["repo", "folder", "class"], "left")
    inside = cut(homed.select("id", "repo", F.when(F.col("here"), F.col("file_id")).otherwise(F.coalesce("home", "file_id")).alias("file_id"), "class", "name", "tells", "doc", "open", "asked").distinct())

    lent = inside.groupBy("repo", F.col("file_id").alias("base_file"), F.col("class").alias("base"), "name").agg(F.min(F.when(F.col("tells"), F.col("doc"))).alias("base_doc"))
    mark = lambda f, c: F.concat_ws(":", f, c)
    step = up.select("repo", "file_id", "class", "base", "base_file")
    search = (
        inside.filter("open and not tells").join(step, ["repo", "file_id", "class"])
        .select("id", "asked", "repo", "name", "base", "base_file", F.array(mark("file_id", "class"), mark("base_file", "base")).alias("path"))
    )
    out = empty
    while True:
        # each round is one level of the hierarchy; a type met before on the way up ends the search, so cycles end too
        search = cut(search.join(lent, ["repo", "base_file", "base", "name"], "left"))
        out = out.unionByName(search.filter("base_doc is not null").groupBy("id").agg(F.min("base_doc").alias("doc"), F.max("asked").alias("asked")).withColumn("source", F.lit("inherited")))
        settled = search.filter("base_doc is not null").select("id").distinct()
        search = (
            search.filter("base_doc is null").join(settled, "id", "left_anti")
            .select("id", "asked", "repo", "name", F.col("base").alias("class"), F.col("base_file").alias("file_id"), "path").join(step, ["repo", "file_id", "class"])
            .filter(~F.array_contains("path", mark("base_file", "base")))
            .select("id", "asked", "repo", "name", "base", "base_file", F.concat("path", F.array(mark("base_file", "base"))).alias("path")).distinct()
        )
        if search.isEmpty():
            return out

"""Generated, minified, vendored and data files told apart from hand-written source.

One pass over the files: an Aho-Corasick automaton reads the leading comments of each file for notices, path rules name
vendored folders, locks and suffixes of tools, and figures of the text name minified code and embedded data. Copies that
sit in several repositories are found by a digest of the text without white space; only (digest, repo) moves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.runtime import cut

# Notices of generators (weight 2 tells alone, weight 1 needs another one) and phrases that speak against.
NOTICES = {
    "code generated by": 2, "@generated": 2, "autogenerated": 2, "auto-generated": 2, "auto generated": 2,
    "automatically generated": 2, "automatically created": 2, "automatically produced": 2, "machine written": 2,
    "machine generated": 2, "machine-generated": 2, "generated by": 1, "generated from": 1, "generated on": 2,
    "file was generated": 2, "file is generated": 2, "generated file": 2, "generated code": 1, "do not edit": 1,
    "do not modify": 1, "don't edit": 1, "do not change": 1, "edits are overwritten": 1, "changes will be lost": 1,
    "changes are lost": 1, "will be overwritten": 1, "automatisch erzeugt": 2, "automatisch generiert": 2,
    "maschinell erzeugt": 2, "generiert von": 1, "erzeugt von": 1, "nicht bearbeiten": 1, "nicht ändern": 1,
    "nicht aendern": 1, "fichier produit par": 2, "généré par": 2, "genere par": 2, "généré automatiquement": 2,
    "genere automatiquement": 2, "fichier généré": 2, "ne pas modifier": 1, "ne pas éditer": 1,
    "generado automáticamente": 2, "generado automaticamente": 2, "generado por": 2, "archivo generado": 2,
    "no editar": 1, "no modificar": 1, "instead of changing this": 1, "instead of editing": 1,
    "vendored copy": 2, "vendored from": 2, "vendored version": 2, "copied from upstream": 2, "copied verbatim from": 2,
    "imported verbatim from": 2, "verbatim copy of": 2, "source tree at rev": 2, "copied unchanged from": 2, "taken verbatim from": 2, "mirrored from": 2, "synced from upstream": 2, "forked from": 1, "released under the": 1, "(c) the ": 1,
    "third-party code": 1, "imported from upstream": 2, "see license.": 1, "report bugs to the": 1, "report issues upstream": 1,
    "this is a copy of": 1, "bundled copy of": 2,
    "used to be generated": -9, "no longer generated": -9, "was once generated": -9, "not generated": -9,
    "maintained by hand": -9, "written by hand": -9, "minified": 0,
}
# Folders of third parties, of generators and of built output.
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules",
               "bower_components", "jspm_packages", "external", "externals", "extern", "deps", "site-packages", "pods", "godeps")
GENERATED_DIRS = ("__generated__", "generated", "_generated", "gen", "autogen")
GENERATED_NAME = r"(?:\.(?:generated|gen|g|pb|pb2|designer|autogen)\.[a-z]+$)|(?:_(?:pb2|pb2_grpc|generated|gen)\.[a-z]+$)|(?:\.pb\.(?:go|cc|h)$)|(?:^zz_generated)"
MINIFIED_NAME = r"[.-]min\.(?:js|mjs|cjs|css|ts)$"
LOCK_NAME = (r"(?:^|/)(?:(?:package|pkg|composer|packages|bun|flake|pdm|poetry|cargo|gemfile|yarn|pnpm|deps|mix|conda)[-_.]lock\b"
             r"|npm-shrinkwrap|yarn\.lock|cargo\.lock|go\.sum)")

DATA_SHARE = 0.85  # share of the text in literals from which a file is data
RUN = 24  # literals in a row from which a list is bulk data, and no ordinary constant
LONG_LINE = 200  # a line as long, or with as many statements as DENSE says, is packed if white space is scarce in it
DENSE = 5  # ends of statements and blocks in a packed line, one in each 40 characters at least
PACKED_SPACES = 0.12  # share of white space below which it is scarce

_LINE = re.compile(r"[^\r\n]+")
_COMMENT_OPEN = re.compile(r"\s*(?:#!.*|//+|/\*+!?|\*+/?|#+|--|;+|<!--|\"\"\"|''')")


def header_of(text: str) -> str:
    """The comment lines at the top of a text, lower-case; it ends at the first line of code."""
    out, block = [], ""
    for m in _LINE.finditer(text.removeprefix("\ufeff")):
        line = m.group()
        bare = line.strip()
        if block:
            out.append(bare)
            if block in bare:
                block = ""
            continue
        if not bare:
            continue
        m = _COMMENT_OPEN.match(line)
        if m is None or re.match(r"#\s*(?:include|define|if|ifn?def|pragma)\b", bare):
            break
        out.append(bare)
        opening = m.group(0).strip()
        for start, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")):
            if opening.startswith(start) and end not in bare[len(opening) if start == end else 2 :]:
                block = end
    return "\n".join(out).lower()


_BY_NAME = re.compile(r"/\*!\s*[\w.@/-]+ v\d+(?:\.\d+)*")
_LITERALS = re.compile(
    r"""(?<![\w.])(?:(?>"[^"\n]*"|'[^'\n]*'|0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?>[\s,;:+()\[\]{}\\]*)){%d,}""" % RUN
    + r"""|(?:"[^"\n]{400,}"|'[^'\n]{400,}'|`[A-Za-z0-9+/=\s]{400,}`)"""
)
_CODE_EXT = {"js", "mjs", "cjs", "ts", "py", "go", "rs", "c", "h", "jsx", "tsx", "java", "cc", "cpp", "hpp", "css"}
_OPEN_STRING = re.compile(r"""["'`][A-Za-z0-9+/=\\x,\s]{400,}\Z""")


def notice_score(automaton, header: str) -> int:
    """Sum of the weights of distinct notices in a header."""
    seen = {}
    for _, (phrase, weight) in automaton.iter(header):
        seen[phrase] = weight
    return sum(seen.values())


_ENDS = re.compile(r"[;{}]")


def _packed(line: str) -> bool:
    n = len(line)
    if n >= LONG_LINE:
        return True
    ends = len(_ENDS.findall(line))
    return ends >= DENSE and ends * 40 >= n


def looks_minified(text: str) -> bool:
    """Packed lines hold most of the text and white space is scarce in them, however short the text is."""
    lines = [x for x in text.split("\n") if _packed(x)]
    held = sum(map(len, lines))
    if not held or held < 0.5 * len(text):
        return False
    return sum(x.count(" ") + x.count("\t") for x in lines) < PACKED_SPACES * held


def looks_data(text: str) -> bool:
    """Runs of literals, or one huge literal, fill the text."""
    held = sum(m.end() - m.start() for m in _LITERALS.finditer(text))
    tail = _OPEN_STRING.search(text)
    if tail:
        held = max(held, len(tail.group(0)))
    return bool(held) and held >= DATA_SHARE * len(text)


def make_kernel():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, weight in NOTICES.items():
        automaton.add_word(phrase, (phrase, weight))
    automaton.make_automaton()
    name_rules = [(re.compile(GENERATED_NAME), "generated_name"), (re.compile(MINIFIED_NAME), "minified_name"), (re.compile(LOCK_NAME), "lock")]
    vendor, generated = frozenset(VENDOR_DIRS), frozenset(GENERATED_DIRS)

    def kernel(file_id, repo, path, content, digest):
        path = (path or "").strip().replace("\\", "/").lower()
        text = content or ""
        parts = path.split("/")
        reasons = [label for rule, label in name_rules if rule.search(path)]
        if not vendor.isdisjoint(parts[:-1]):
            reasons.append("vendor_path")
        if not generated.isdisjoint(parts[:-1]):
            reasons.append("generated_path")
        ext = parts[-1].rpartition(".")[2]
        if text and ext not in ("md", "markdown", "rst", "txt"):
            header = header_of(text)
            if header:
                if notice_score(automaton, header) >= 2:
                    reasons.append("notice")
                if _BY_NAME.search(header):
                    reasons.append("library_banner")
            if ext == "json":
                if '"lockfileVersion"' in text or (text.count('"integrity"') >= 2 and text.count('"resolved"') >= 2):
                    reasons.append("lock")
            elif ext in _CODE_EXT or not ext:
                if looks_data(text):
                    reasons.append("data")
                elif looks_minified(text):
                    reasons.append("minified")
        yield file_id, repo, reasons, digest

    return kernel


_SCHEMA = StructType([
    StructField("file_id", LongType()), StructField("repo", StringType()), StructField("reasons", ArrayType(StringType())), StructField("digest", StringType()),
])


def copy_digest(content: Column) -> Column:
    """Digest of the text without white space; null where no letter or digit is left."""
    bare = F.regexp_replace(content, r"\s+", "")
    return F.when(bare.rlike(r"[\p{L}\p{N}]"), F.md5(bare))


def classify(files: DataFrame) -> DataFrame:
    """(file_id, reasons): why each file counts as not written by hand here; no reasons for hand-written files.

    files: file_id, repo, path, content. A null path or content gives no reason of that kind. A file delivered more than
    once gives one row with all reasons of its deliveries. A text found in two or more repos is a copy in each of them.
    """
    base = files.select("file_id", "repo", "path", "content").filter("file_id is not null")
    # contents are read once: what the copies need is kept beside the reasons
    seen = cut(map_rows(base.select("file_id", "repo", "path", "content", copy_digest(F.col("content")).alias("digest")), make_kernel, _SCHEMA))
    told = seen.filter("digest is not null")
    copies = told.select(F.col("digest").alias("__digest"), "repo").filter("repo is not null").distinct().groupBy("__digest").agg(F.count(F.lit(1)).alias("__repos")).filter("__repos > 1").select("__digest")
    marked = told.join(copies, F.col("digest") == F.col("__digest"), "left").select(
        "file_id", F.when(F.col("__digest").isNotNull(), F.array_append("reasons", "copy")).otherwise(F.col("reasons")).alias("reasons"))
    every = marked.unionByName(seen.filter("digest is null").select("file_id", "reasons"))
    return every.groupBy("file_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))

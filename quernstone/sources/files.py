"""Files of a tree as a table: discovery, ignore rules, skip reasons, modes; and the sinks."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernstone.functions.paths import extension, normal_path
from quernstone.runtime import cut

# Suffixes by mode, folders that are never read, files that are no source.
PROSE = "md markdown txt rst adoc asciidoc".split()
SKIPPED_DIRS = ".git node_modules dist build target .venv __pycache__ vendor coverage".split()
BINARY = "png jpg jpeg gif ico pdf zip gz tgz jar class exe dll so dylib woff woff2 ttf mp3 mp4 wasm".split()
MAX_BYTES = 5 * 1024 * 1024
_OPEN_END = r"(?:[\u00C2-\u00DF]|[\u00E0-\u00EF][\u0080-\u00BF]?|[\u00F0-\u00F4][\u0080-\u00BF]{0,2})\z"


def discover(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, mode, skipped, content) of all files below a folder of any file system, without those that ignore rules leave out.

    path is relative, content bytes, which are read only where they are asked for; mode is what a file is searched as, skipped why it is not read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root if "://" in root or root.startswith("file:") else os.path.abspath(root)).strip("/")
    path = F.regexp_replace("path", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*" + re.escape(place) + "/?", "")
    found = f.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    kept = found.filter(~ignored(F.col("path"), rules)) if rules else found
    return kept.select("path", "size", "mtime", mode(F.col("path")).alias("mode"), skip_reason(F.col("path"), F.col("size")).alias("skipped"), "content")


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """The pattern of one ignore rule, and whether it takes a path back in."""
    keep = rule.startswith("!")
    body = rule[1:] if keep else rule
    folder = body.endswith("/")
    body = body.strip("/") if not body.startswith("/") else body.rstrip("/")
    anchored = body.startswith("/") or "/" in body.strip("/")
    out, i, body = "", 0, body.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), keep


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules leave a path out; of those that match, the last decides."""
    out = F.lit(False)
    for r in rules:
        r = r.strip()
        if r and not r.startswith("#"):
            pattern, keep = ignore_pattern(r)
            out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def looks_binary(content: Column, sample: int = 4096) -> Column:
    """A zero byte within the first bytes, or a third of them other than text."""
    head = F.hex(F.substring(content, 1, sample))
    odd = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit("(?:0[0-8BCEF]|1[0-9A-F]|7F) "))
    return F.regexp_replace(head, "(..)", "$1 ").rlike("(?:^| )00 ") | (odd * 3 > F.length(head) / 2)


# Suffixes of documents whose text has to be extracted, folders of records, and names of generated files.
EXTRACTED = "pdf docx".split()
RECORDS = r"(?:^|/)(?:records|triage)/"
GENERATED = r"(?:^|/)(?:__generated__|generated|gen)/|\.(?:generated|gen|g|pb)\.[A-Za-z]+$|_(?:pb2|generated)\.[A-Za-z]+$"


def mode(path: Column) -> Column:
    """What a file is searched as: code, prose, extracted-prose, records, or null for what is none."""
    ext = extension(path)
    return F.when(ext.isin(EXTRACTED), "extracted-prose").when(ext.isin(BINARY), None).when(path.rlike(RECORDS), "records").when(ext.isin(PROSE), "prose").otherwise("code")


def policy(path: Column, size: Column) -> Column:
    """What becomes of a file: `skip`, `metadata` where a tool wrote it, so that only its facts are kept, else `index`."""
    return F.when(skip_reason(path, size).isNotNull(), "skip").when(normal_path(path).rlike(GENERATED), "metadata").otherwise("index")


def skip_reason(path: Column, size: Column) -> Column:
    """Why a file is not read; null where it is."""
    p = normal_path(path)
    dirs = "(?:^|/)(?:" + "|".join(re.escape(d) for d in SKIPPED_DIRS) + ")/"
    return (
        F.when(F.coalesce(p, F.lit("")) == "", "no_path").when(p.rlike(dirs), "skipped_dir").when(extension(p).isin(BINARY), "binary").when(p.rlike(r"[.-]min\.(?:js|css)$"), "minified")
        .when(p.rlike(r"(?i)(?:^|/)[\w.-]*(?:lock|shrinkwrap)[\w.-]*\.json$"), "lock_file").when(size > MAX_BYTES, "oversize")
    )


def decoded(content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Bytes as text, cut to whole characters within a number of bytes; malformed bytes become replacement characters."""
    head = F.substring(content, 1, max_bytes)
    text = F.decode(head, "ISO-8859-1")
    valid = F.try_validate_utf8(head.cast("string"))
    # bytes of a character that the cut left without its end; other malformed bytes stay, as replacement characters
    open_end = F.regexp_extract(text, _OPEN_END, 0)
    whole = F.make_valid_utf8(F.substring(head, F.lit(1), F.length(head) - F.length(open_end)).cast("string"))
    return F.coalesce(valid, F.when(F.length(content) > max_bytes, whole).otherwise(F.make_valid_utf8(head.cast("string"))), text)


def rows_at(spark: SparkSession, path: str, key: str, ids: list[int]) -> DataFrame:
    """The rows of some keys of a table that is sorted by key: statistics of row groups leave all others unread. ids: as many as a query names."""
    return spark.read.parquet(path).filter(F.col(key).isin(ids))


def write_modes(df: DataFrame, path: str, files: int = 0) -> None:
    """A table by mode, so that a search of one mode reads its own partitions; sorted within files for skipping."""
    out = df if not files else df.repartition(files, "mode")
    out.sortWithinPartitions("mode").write.mode("overwrite").partitionBy("mode").parquet(path)


def compact(spark: SparkSession, path: str, target: str, partitions: int) -> None:
    """Small pieces of a table rewritten as fewer."""
    spark.read.parquet(path).repartition(partitions).write.mode("overwrite").parquet(target)


def assemble(pieces: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Pieces with ids from 0 as one table with ids of its own: each piece is shifted by the greatest id before it."""
    out, shift = None, 0
    for p in pieces:
        moved = p.withColumn(key, F.col(key) + F.lit(shift))
        out = moved if out is None else out.unionByName(moved)
        shift += p.agg(F.max(key)).first()[0] or 0
        shift += 1
    return out


def merged_postings(pieces: list[DataFrame]) -> DataFrame:
    """(mode, token, doc_id, tf) of pieces of an index as one: postings of one token and document in several pieces add up."""
    every = pieces[0]
    for p in pieces[1:]:
        every = every.unionByName(p)
    return every.groupBy("mode", "token", "doc_id").agg(F.sum("tf").alias("tf"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): edges as lines of a Graphviz digraph, without its first and last line."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '(["\\\\])', "\\\\$1"), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(";")).alias("line"))


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """Rows as JSON lines, a file for each partition."""
    df.write.mode("overwrite").option("compression", compression).json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON lines in files of any number, compressed or not, by a stated schema: fields that it lacks are left out, lines that are no JSON give no row."""
    marked = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = spark.read.schema(marked + ", __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    return cut(rows).filter("__bad is null").drop("__bad")

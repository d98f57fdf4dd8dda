"""Chunkers of text formats: headings, line patterns, bytes, content-defined cuts, embedded segments, comments."""

from __future__ import annotations

from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.operators.keyed import ordered_rank
from quernstone.runtime import cut

# Lines that begin a chunk, by the suffix of the file.
HEADINGS = {
    "md": r"^#{1,6} .+$", "ini": r"^\s*\[{1,2}[^\]]+\]{1,2}\s*$", "toml": r"^\s*\[{1,2}[^\]]+\]{1,2}\s*$", "yaml": r"^[A-Za-z0-9_\"'][^#]*:(\s|$)", "rst": r"^[=\-~^\"'`*+#]{3,}\s*$",
    "py": r"^\s*(?:async\s+def|def|class)\s+\w+", "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class)\s+\w+|^\s*(?:export\s+)?const\s+\w+\s*=\s*(?:async\s*)?\(",
    "go": r"^(?:func|type)\s+", "rs": r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+", "c": r"^(?:static\s+)?(?:inline\s+)?[\w*]+\s+[\w*\s]*\w+\s*\(", "sql": r"(?i)^\s*(?:create|insert|select|update|delete|alter|drop|with)\b",
    "dockerfile": r"^(?:FROM|RUN|COPY|CMD|ENTRYPOINT)\b", "makefile": r"^[\w.-]+:", "proto": r"^\s*(?:message|service|enum|rpc)\s+\w+", "graphql": r"^\s*(?:type|interface|enum|input|query|mutation)\s+\w+",
}
for _alias, _of in (("mjs", "js"), ("cjs", "js"), ("ts", "js"), ("h", "c"), ("markdown", "md"), ("yml", "yaml")):
    HEADINGS[_alias] = HEADINGS[_of]


def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no, line): lines of a text from 1; carriage returns at line ends go."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1).withColumn("line", F.regexp_replace("line", "\r$", ""))


def sections(df: DataFrame, key: str, suffix: str, text: str) -> DataFrame:
    """(key, section, title, start_line, end_line): chunks that begin at heading lines and run to the next.

    What is before the first heading is no chunk; a text without any heading is one chunk, `root`.
    """
    starts = F.lit(False)
    for s, p in HEADINGS.items():
        starts = F.when(F.col(suffix) == s, F.col("x").rlike(p)).otherwise(starts)
    lines = F.transform(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    marked = df.select(key, suffix, lines.alias("__l"))
    exploded = marked.select(key, suffix, F.size("__l").alias("lines"), F.explode("__l").alias("l")).select(key, suffix, "lines", F.col("l.n").alias("n"), F.col("l.x").alias("x"))
    heads = exploded.filter(starts)
    w = Window.partitionBy(key).orderBy("n")
    found = heads.select(key, F.row_number().over(w).alias("section"), F.trim("x").alias("title"), F.col("n").alias("start_line"), (F.coalesce(F.lead("n").over(w) - 1, F.col("lines"))).alias("end_line"))
    whole = marked.join(heads.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("section"), F.lit("root").alias("title"), F.lit(1).alias("start_line"), F.size("__l").alias("end_line"))
    return found.unionByName(whole)


SLICE = 800  # characters of a slice of a text that no chunker knows


def dispatched(df: DataFrame, key: str, suffix: str, text: str, size: int = SLICE) -> DataFrame:
    """(key, chunker, part, start_line, end_line): every text by the chunker that its suffix asks for.

    heading for prose and declaration for code with lines that begin a chunk; slices of `size` characters for all other texts. Line ends are counted as one
    character. A text is split into lines once.
    """
    found = sections(df, key, suffix, text)
    prose = F.col(suffix).isin("md", "markdown", "rst")
    named = found.filter("title != 'root'").join(df.select(key, suffix).distinct(), key).select(key, F.when(prose, "heading").otherwise("declaration").alias("chunker"), F.col("section").alias("part"), "start_line", "end_line")
    rest = df.select(key, F.regexp_replace(text, "\r\n?", "\n").alias("t")).join(found.filter("title != 'root'").select(key).distinct(), key, "left_anti")
    n = F.length("t")
    at = rest.select(key, "t", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))).alias("at"))
    feeds = lambda upto: F.length(upto) - F.length(F.replace(upto, F.lit("\n"), F.lit("")))
    last = F.greatest(F.least(F.col("at") + size, F.col("n")) - 1, F.lit(0))
    slices = at.select(key, F.lit("slices").alias("chunker"), (F.floor(F.col("at") / size) + 1).cast("int").alias("part"), (feeds(F.substring("t", F.lit(1), F.col("at"))) + 1).alias("start_line"), (feeds(F.substring("t", F.lit(1), last)) + 1).alias("end_line"))
    return named.unionByName(slices)


def statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, statement): statements of SQL text, cut at semicolons outside quotes and comments."""
    bare = F.regexp_replace(F.col(text), r"--[^\n]*|/\*(?s:.*?)\*/", " ")
    parts = F.regexp_extract_all(bare, F.lit(r"((?:[^;'\"]|'(?:[^']|'')*'|\"[^\"]*\")+)"), F.lit(1))
    return df.select(key, F.posexplode(F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")).alias("n", "statement"))


def table_refs(statement: Column) -> Column:
    """Distinct tables a statement reads or writes, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(statement, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([A-Za-z_][\w.]*)"), F.lit(1)), lambda x: F.lower(x))))


_BYTES = StructType([StructField("key", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("bytes", IntegerType())])


def byte_pieces(df: DataFrame, key: str, text: str, max_bytes: int) -> DataFrame:
    """(key, piece, start, end, bytes): greatest pieces of at most max_bytes UTF-8 bytes, never inside a character."""
    def make():
        from bisect import bisect_right
        from itertools import accumulate

        def kernel(k, t):
            if not t:
                return
            ends = list(accumulate(len(c.encode("utf-8", "surrogatepass")) for c in t))
            at, done, piece = 0, 0, 0
            while at < len(t):
                to = max(at + 1, bisect_right(ends, done + max_bytes))
                yield k, piece, at, to, ends[to - 1] - done
                at, done, piece = to, ends[to - 1], piece + 1
        return kernel

    return map_rows(df.select(F.col(key).cast("long"), text), make, _BYTES).withColumnRenamed("key", key)


# Seed, multiplier and addend of the sequence that gives the rolling hash its values.
GEAR_SEED, GEAR_MULTIPLIER, GEAR_ADDEND = 0x12345678, 1103515245, 12345


def gear_table() -> list[int]:
    """The 256 values of the rolling hash: a linear congruential sequence."""
    out, seed = [], GEAR_SEED
    for _ in range(256):
        seed = (seed * GEAR_MULTIPLIER + GEAR_ADDEND) & 0xFFFFFFFF
        out.append(seed)
    return out


def content_cuts(text: str, low: int, average: int, high: int, least: int = 0, window: int = 64) -> list[tuple[int, int]]:
    """Segments whose ends depend on the text around them only: a cut where the rolling hash has enough low zeros."""
    if not text:
        return []
    if len(text) < least:
        return [(0, len(text))]
    mask = (1 << max(4, min(20, round(log2(average))))) - 1
    n, least_size = len(text), max(low, window)
    if least_size < 32:
        return _slow_cuts(text, least_size, high, mask)
    # a value leaves the hash after 32 shifts, so that from 32 characters on it depends on the last 32 alone
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    values = np.array(gear_table(), np.uint32)[codes & 0xFF]
    h = values.copy()
    for k in range(1, min(32, n)):
        h[k:] += values[:-k] << np.uint32(k)
    anchors = np.flatnonzero((h & np.uint32(mask)) == 0)
    out, start = [], 0
    while start < n:
        i = np.searchsorted(anchors, start + least_size - 1)
        end = int(anchors[i]) + 1 if i < len(anchors) else n
        end = min(end, start + high, n)
        out.append((start, end))
        start = end
    return out


def _slow_cuts(text: str, least_size: int, high: int, mask: int) -> list[tuple[int, int]]:
    """The definition of content_cuts, a character at a time."""
    gear = gear_table()
    out, start, h = [], 0, 0
    for i, c in enumerate(text):
        h = ((h << 1) + gear[ord(c) & 0xFF]) & 0xFFFFFFFF
        size = i + 1 - start
        if (size >= least_size and not h & mask) or size >= high:
            out.append((start, i + 1))
            start, h = i + 1, 0
    if start < len(text):
        out.append((start, len(text)))
    return out


_CUTS = StructType([StructField("key", LongType()), StructField("segment", IntegerType()), StructField("start", LongType()), StructField("end", LongType())])


def cdc(df: DataFrame, key: str, text: str, low: int = 4096, average: int = 16384, high: int = 65536, least: int = 262144) -> DataFrame:
    """(key, segment, start, end) of content-defined segments; shorter texts than `least` come whole."""
    def make():
        def kernel(k, t):
            for n, (a, b) in enumerate(content_cuts(t or "", low, average, high, least)):
                yield k, n, a, b
        return kernel

    return map_rows(df.select(F.col(key).cast("long"), text), make, _CUTS).withColumnRenamed("key", key)


_FENCE = r"(?m)^(?:```|~~~)([\w+-]*)[^\n]*\n((?s:.*?))\n(?:```|~~~)[ \t]*$"


def front_matter(text: Column) -> Column:
    """The block at the top between ---, +++ or ;;; lines; null where there is none."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    m = F.regexp_extract(t, r"^﻿?(---|\+\+\+|;;;)[ \t]*\n((?s:.*?))\n\1[ \t]*(?:\n|$)", 2)
    return F.when(m != "", m)


def fenced(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, language, code) of fenced blocks."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(_FENCE), F.lit(1)).alias("language"), F.regexp_extract_all(t, F.lit(_FENCE), F.lit(2)).alias("code"))
    return df.select(key, F.posexplode(both).alias("n", "s")).select(key, "n", F.col("s.language").alias("language"), F.col("s.code").alias("code"))


COMMENT = r"(?m)/\*(?s:.*?)\*/|(?:^|[ \t])//[^\n]*|^[ \t]*#[^\n!\[][^\n]*"


def comments(df: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    """(key, n, comment): comments of source text with at least `least` characters of text."""
    found = F.regexp_extract_all(F.regexp_replace(F.col(text), "\r\n?", "\n"), F.lit(COMMENT), F.lit(0))
    clean = F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*(?:/\*+|\*+/|\*|//+|#+)|\*+/\s*$", " "), r"\s+", " ")))
    return df.select(key, F.posexplode(F.filter(clean, lambda c: F.length(c) >= least)).alias("n", "comment"))


LICENSE = "(?i)(spdx-license-identifier|licensed under|copyright|all rights reserved|permission is hereby granted|this file is part of)"
GENERATED = "(?i)(generated by|auto-generated|autogenerated|do not edit|automatically)"


def boilerplate(text: Column) -> Column:
    """Normalised text of the comment block at the top: without markers, years and file names; null where there is none."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    block = F.regexp_extract(t, r"^((?:[ \t]*(?:/\*(?s:.*?)\*/|//[^\n]*|#[^\n]*|;[^\n]*|--[^\n]*)?[ \t]*\n)*)", 1)
    bare = F.regexp_replace(block, r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|;+|--)|\*+/", " ")
    norm = F.regexp_replace(F.lower(bare), r"\b(?:19|20)\d{2}(?:\s*-\s*(?:19|20)\d{2})?\b", "<year>")
    norm = F.trim(F.regexp_replace(F.regexp_replace(norm, r"\b[\w.-]+\.(?:c|h|js|ts|py|go|rs)\b", "<file>"), r"\s+", " "))
    return F.when(norm != "", norm)


# Lines from either end of a file among which a comment block is looked for, and lines that it has at most.
BLOCK_WITHIN, BLOCK_LINES = 160, 120
_COMMENT_LINE = r"^[ \t]*(?:$|//|#|;|--|/?\*)"


def comment_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, start_line, end_line): the comment lines a text begins (leading) and ends with (trailing), blank ones at the outer and inner edge aside.

    A text of comments alone has a leading block only. A block of more than BLOCK_LINES lines is cut there, as the rest is no boilerplate.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    code = lambda ls: F.array_position(F.transform(ls, lambda x: ~x.rlike(_COMMENT_LINE)), True)
    shown = lambda ls: F.array_position(F.transform(ls, lambda x: x.rlike(r"\S")), True)
    n = F.size("l")
    rows = df.select(key, lines.alias("l")).withColumns({"head": F.slice("l", 1, BLOCK_WITHIN), "tail": F.slice(F.reverse("l"), 1, BLOCK_WITHIN)})

    def block(side):
        """First and last line of a block, from its end of the text on; null where there is none."""
        ls = F.col(side)
        stop = F.when(code(ls) > 0, code(ls) - 1).otherwise(F.size(ls))
        first = shown(ls)
        kept = F.slice(ls, 1, F.greatest(stop, F.lit(0)).cast("int"))
        last = stop - F.when(shown(F.reverse(kept)) > 0, shown(F.reverse(kept)) - 1).otherwise(F.lit(0))
        return F.when((first > 0) & (first <= stop), F.struct(first.alias("a"), F.least(last, first + BLOCK_LINES - 1).alias("b")))

    lead, trail = block("head"), block("tail")
    found = rows.select(key, n.alias("n"), lead.alias("lead"), trail.alias("trail"), (code(F.col("l")) > 0).alias("has_code"))
    leading = found.filter("lead is not null").select(key, F.lit("leading").alias("part"), F.col("lead.a").alias("start_line"), F.col("lead.b").alias("end_line"))
    trailing = found.filter("trail is not null and has_code").select(key, F.lit("trailing").alias("part"), (F.col("n") - F.col("trail.b") + 1).alias("start_line"), (F.col("n") - F.col("trail.a") + 1).alias("end_line"))
    return leading.unionByName(trailing).withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line")})


LINES_BIN, CHARS_BIN = 64, 4096  # widths of the stretches by which intervals of a file meet


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Rows once for each stretch of a file that lies between two places, either of which may be the first, ends included; none where one is null."""
    a, b = F.least(start, end), F.greatest(start, end)
    return df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__bin", F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))


def coverage(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, share): greatest share of a chunk that one block of its file covers; 0 where none does, chunks of files without blocks are left out.

    Blocks and chunks meet by stretches of the file, so that only those near each other are compared.
    """
    j = _binned(chunks, "start", "end", CHARS_BIN).join(_binned(blocks, "b_start", "b_end", CHARS_BIN), ["file_id", "__bin"])
    overlap = F.greatest(F.least("end", "b_end") - F.greatest("start", "b_start"), F.lit(0))
    best = j.groupBy("id").agg(F.max(overlap / (F.col("end") - F.col("start"))).alias("share"))
    every = chunks.join(blocks.select("file_id").distinct(), "file_id", "left_semi").select("id").distinct()
    return every.join(best, "id", "left").select("id", F.coalesce("share", F.lit(0.0)).alias("share"))


def line_matches(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, match): matches whose lines overlap a chunk's, ends included.

    matches: file_id, match, m_start, m_end; chunks: file_id, id, startLine, endLine. Both meet by stretches of the file; chunks
    without lines have no match.
    """
    j = _binned(chunks, "startLine", "endLine", LINES_BIN).join(_binned(matches, "m_start", "m_end", LINES_BIN), ["file_id", "__bin"])
    # of the stretches that both touch the first counts
    first = F.floor(F.greatest("startLine", "m_start") / LINES_BIN) == F.col("__bin")
    return j.filter("m_start <= endLine and startLine <= m_end").filter(first).select("id", "match")


def chunk_of(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(point, id): the first chunk of a file that ends after a point, else its last chunk.

    points: file_id, point, at; chunks: file_id, id, start, end. Both come sorted together in one window over a file, so no pair of point and chunk is
    formed but the one that is asked for.
    """
    c = chunks.select("file_id", F.col("end").alias("at"), "id", F.lit(None).cast("string").alias("point"))
    p = points.select("file_id", "at", F.lit(None).cast("long").alias("id"), F.col("point").cast("string").alias("point"))
    both = c.unionByName(p)
    # from the end on, the last chunk met before a point is the first that ends after it: one pass over a file; chunks that end at the point come after it
    after = Window.partitionBy("file_id").orderBy(F.desc("at"), F.desc(F.col("id").isNull()), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file_id")
    found = both.withColumn("next", F.last("id", ignorenulls=True).over(after)).withColumn("end_id", F.max(F.when(F.col("id").isNotNull(), F.struct("at", "id"))).over(last)["id"])
    return found.filter("point is not null").select("file_id", "point", F.coalesce("next", "end_id").alias("id")).filter("id is not null")


# Characters around a chunk that are part of its identity, and those after a collision.
NEAR_CONTEXT, WIDE_CONTEXT = 128, 1024


def identity_parts(content: Column, start: Column, end: Column) -> Column:
    """struct of digests of a range of a text and of what is around it, near and wide; null where there is nothing around."""
    lo, hi = F.greatest(start, F.lit(0)), F.greatest(end, start, F.lit(0))
    piece = lambda a, b: F.substring(content, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    digest = lambda t: F.when(t != "", F.md5(t))
    before = lambda n: digest(piece(F.greatest(lo - n, F.lit(0)), lo))
    after = lambda n: digest(piece(hi, hi + n))
    return F.struct(F.md5(piece(lo, hi)).alias("span"), before(NEAR_CONTEXT).alias("pre"), after(NEAR_CONTEXT).alias("post"), before(WIDE_CONTEXT).alias("wide_pre"), after(WIDE_CONTEXT).alias("wide_post"))


def uids(chunks: DataFrame) -> DataFrame:
    """(id, uid): ids of chunks that survive moves: namespace, path, digests of the text and of what is around it.

    chunks: id, repo, path, parts (see identity_parts), salt, place. Chunks of one uid take their salt into the text's digest; those that still agree the wider
    surroundings; those that do even then get ordinals in the order of their place. Collisions are counted by uid, never gathered.
    """
    def uid(salted: bool, wide: bool):
        p = F.col("parts")
        span = F.md5(F.concat_ws(":", F.lit("span"), "salt", p["span"])) if salted else p["span"]
        return F.concat_ws(":", F.lit("ck64:v1"), F.coalesce("repo", F.lit("repo")), F.coalesce("path", F.lit("")), span, p["wide_pre" if wide else "pre"], p["wide_post" if wide else "post"])

    def parted(df):
        """Rows whose uid is theirs alone, and the others."""
        again = df.groupBy("uid").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("uid").alias("__uid"))
        marked = cut(df.join(again, F.col("uid") == F.col("__uid"), "left"))
        return marked.filter("__uid is null").drop("__uid"), marked.filter("__uid is not null").drop("__uid")

    done, rest = parted(chunks.withColumn("uid", uid(False, False)))
    out = done.select("id", "uid")
    for wide in (False, True):
        done, rest = parted(rest.withColumn("uid", uid(True, wide)))
        out = out.unionByName(done.select("id", "uid"))
    ranked = ordered_rank(rest.select("id", "uid", "place"), ["uid"], [F.asc("place"), F.asc("id")], "n")
    return out.unionByName(ranked.select("id", F.concat("uid", F.lit(":ord"), F.col("n").cast("string")).alias("uid")))


_WORDS = StructType([StructField("token", StringType()), StructField("parts", StringType())])


def segment_word(word: str, words: frozenset[str], limit: int = 32) -> list[str]:
    """A token as words of a dictionary: the longest match first, unless splitting by the most characters, then fewest parts, covers strictly more."""
    greedy, i = [], 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in words:
                greedy.append(word[i:j])
                i = j
                break
        else:
            if greedy and greedy[-1][:1] == "\0":
                greedy[-1] += word[i]
            else:
                greedy.append("\0" + word[i])
            i += 1
    score = lambda parts: sum(len(p) for p in parts if p[0] != "\0")
    best = greedy
    if len(word) <= limit:
        table = [(0, 0, [])]
        for j in range(1, len(word) + 1):
            options = []
            for i in range(j):
                covered, parts, path = table[i]
                piece = word[i:j]
                if piece in words:
                    options.append((covered + len(piece), parts - 1, [*path, piece]))
                elif j - i == 1:
                    if path and path[-1][0] == "\0":
                        options.append((covered, parts, [*path[:-1], path[-1] + piece]))
                    else:
                        options.append((covered, parts - 1, [*path, "\0" + piece]))
            table.append(max(options, key=lambda o: (o[0], o[1])))
        if score(table[-1][2]) > score(greedy):
            best = table[-1][2]
    return [p.lstrip("\0") for p in best]


def segmented(tokens: DataFrame, words: list[str]) -> DataFrame:
    """(token, parts) of tokens against a dictionary, which is broadcast: its size is the caller's to bound."""
    bound = tokens.sparkSession.sparkContext.broadcast(frozenset(words))

    def make():
        known = bound.value

        def kernel(token):
            yield token, " ".join(segment_word(token, known))
        return kernel

    return map_rows(tokens.select("token"), make, _WORDS)

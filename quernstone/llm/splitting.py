"""Oversized chunks cut at natural boundaries by recursive bisection, with overlaps."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.llm.chunktext import files_with_chunks, with_file_id
from quernstone.runtime import table

_INDENT = re.compile(r"[^\S\n]*")
_BLOCK_END = frozenset(["}", "};", "})", "});", "},", "]", "];", ")", ");", "end", "fi", "done", "```", "---"])


class TextIndex:
    """Line starts and byte counts of a text, by code point."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.breaks = np.flatnonzero(codes == 10).tolist()
        self.ascii = text.isascii()
        if not self.ascii:
            widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            self.upto = [0, *np.cumsum(widths).tolist()]

    def size(self, start: int, end: int) -> int:
        """UTF-8 bytes of [start, end)."""
        return end - start if self.ascii else self.upto[end] - self.upto[start]

    def lines(self, start: int, end: int) -> int:
        """Line feeds in [start, end), one at the very end not counted, plus one."""
        return bisect_left(self.breaks, end - 1) - bisect_left(self.breaks, start) + 1

    def line_of(self, at: int) -> int:
        """One-based number of the line that holds position at."""
        return bisect_left(self.breaks, at) + 1

    def at_size(self, start: int, end: int, size: float) -> int:
        """Last position p in [start, end] with size(start, p) at most size."""
        if self.ascii:
            return min(end, start + int(size))
        return min(end, bisect_right(self.upto, self.upto[start] + size, start, end + 1) - 1)


def split(index: TextIndex, start: int, end: int, max_bytes: int, max_lines: int, overlap_lines: int) -> list[tuple[int, int]]:
    """[start, end) as pieces of at most max_bytes and max_lines that cover it in order.

    A range within the limits is its own piece. Otherwise it is bisected at the strongest boundary near its middle (after
    a blank line, after the end of a block, at a less indented line, at any line, at white space, anywhere) until each part
    with its overlap fits; then each part but the first is extended back over overlap_lines lines. Where these and the line that
    follows are beyond a limit together, as many whole lines as do fit are shared, down to none; before a line that is beyond the limit alone, and
    inside it, they take half of the bytes at most, so that pieces go on.
    """
    if index.size(start, end) <= max_bytes and index.lines(start, end) <= max_lines:
        return [(start, end)]
    shared_lines = max(0, min(overlap_lines, max_lines - 1))

    def back(at: int) -> int:
        """Start of the overlap before a part that begins at `at`."""
        if at <= start or not shared_lines:
            return at
        k = bisect_left(index.breaks, at)
        if not (k and index.breaks[k - 1] == at - 1):
            k += 1  # at is inside a line: the part of it before counts as one
        best, e = at, bisect_left(index.breaks, at)
        line = index.size(at, min(end, index.breaks[e] + 1) if e < len(index.breaks) else end)  # what follows up to its line's end
        whole = k == e and index.size(index.breaks[k - 1] + 1 if k else 0, at) == 0
        room = max_bytes - line if whole and line <= max_bytes else max_bytes // 2
        for n in range(1, shared_lines + 1):
            j = k - 1 - n
            begin = max(start, index.breaks[j] + 1) if j >= 0 else max(start, 0)
            if index.size(begin, at) > room:
                break
            best = begin
            if begin == start:
                break
        return best

    def fits(a: int, b: int) -> bool:
        x = back(a)
        return index.size(x, b) <= max_bytes and index.lines(x, b) <= max_lines

    parts, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        if fits(a, b) or b - a <= 1:
            parts.append((a, b))
            continue
        cut = boundary(index, a, b, by_lines=index.size(a, b) <= max_bytes)
        todo += [(cut, b), (a, cut)]
    return [(back(a), b) for a, b in parts]


def boundary(index: TextIndex, a: int, b: int, by_lines: bool) -> int:
    """The strongest place to cut [a, b), near the middle by bytes or by lines; ties go to the nearest."""
    text, breaks = index.text, index.breaks
    lo, hi = bisect_left(breaks, a), bisect_left(breaks, b - 1)  # breaks[lo:hi] end a line inside
    if hi > lo:
        if by_lines:
            middle = breaks[(lo + hi) // 2] + 1
            first, last = breaks[lo + (hi - lo) // 4] + 1, breaks[min(hi - 1, lo + 3 * (hi - lo) // 4)] + 1
        else:
            total = index.size(a, b)
            first, middle, last = (index.at_size(a, b, total * x) for x in (0.25, 0.5, 0.75))
        best, best_rank = 0, None
        for k in range(max(lo, bisect_left(breaks, first - 1)), min(hi, bisect_right(breaks, last - 1))):
            p = breaks[k] + 1
            before = text[breaks[k - 1] + 1 if k else 0 : breaks[k]].strip()
            first_char = _INDENT.match(text, p).end()
            indent = first_char - p
            strength = 4 if not before else 3 if before in _BLOCK_END and not indent else 2 if before in _BLOCK_END or not indent else 1
            if first_char == len(text) or text[first_char] == "\n":
                strength = 1  # a blank line follows
            rank = (strength, -abs(p - middle))
            if best_rank is None or rank > best_rank:
                best, best_rank = p, rank
        if best:
            return best
    middle = max(a + 1, min(b - 1, index.at_size(a, b, index.size(a, b) / 2)))
    reach = max(1, (b - a) // 4)
    left, right = text.rfind(" ", middle - reach, middle), text.find(" ", middle, middle + reach)
    near = [p + 1 for p in (left, right) if p >= 0 and a < p + 1 < b]
    if near:
        return min(near, key=lambda p: abs(p - middle))
    if text[middle] == "\n" and text[middle - 1] == "\r" and middle + 1 < b:
        return middle + 1
    return middle


_PIECE = StructType([
    StructField("id", LongType()), StructField("mode", StringType()), StructField("piece", IntegerType()),
    StructField("start", LongType()), StructField("end", LongType()), StructField("startLine", IntegerType()), StructField("endLine", IntegerType()),
])


def _make():
    def kernel(content, refs):
        index = TextIndex(content)
        for r in refs:
            start, end = max(0, r["start"]), min(r["end"], len(content))
            if end <= start:
                continue
            if index.size(start, end) <= r["max_bytes"] and index.lines(start, end) <= r["max_lines"]:
                continue
            for k, (a, b) in enumerate(split(index, start, end, r["max_bytes"], r["max_lines"], r["overlap_lines"])):
                yield r["id"], r["mode"], k, a, b, index.line_of(a), index.line_of(b - 1)
    return kernel


def oversized_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, mode, piece, start, end, startLine, endLine): the pieces of each chunk beyond the limits of its mode.

    start and end count code points of the file, end exclusive; lines are one-based. Null or inverted ranges, ranges past
    the end of the text, modes without limits and files without content give nothing; a start below 0 counts as 0.
    """
    chunks, files, limits = (table(spark, sf_dir, t) for t in ("chunks", "files", "chunklimits"))
    limits = limits.filter("mode is not null and max_bytes > 0 and max_lines > 0").groupBy("mode").agg(
        F.min("max_bytes").alias("max_bytes"), F.min("max_lines").alias("max_lines"), F.max(F.coalesce("overlap_lines", F.lit(0))).alias("overlap_lines"))
    refs = chunks.select("id", "mode", "repo", "file_id", "file", "start", "end").filter("id is not null and end > start").join(limits, "mode")
    # a code point has at most 4 bytes and makes at most one line: shorter ranges cannot be beyond a limit
    refs = refs.filter("(end - start) * 4 > max_bytes or (end - start) + 1 > max_lines")
    ref = F.struct("id", "mode", "start", "end", "max_bytes", "max_lines", "overlap_lines")
    texts = files_with_chunks(with_file_id(refs, files), files, ref)
    return map_rows(texts.select("content", "refs"), _make, _PIECE).distinct()

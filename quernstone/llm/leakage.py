"""Held-out passages inside corpus documents: q-gram lemma in diagonal bands, verified by banded alignment.

Texts are compared as runs of letters and digits. Every q-gram of a document is looked up among those of the items; hits of
one item on neighbouring diagonals (document position minus item position) are counted in overlapping bands. A passage
with few altered words keeps at least as many q-grams as the lemma states: items of which no run of words has so many are left out without loss. Altered words part a
passage into at most one stretch more than there are of them, each on one diagonal: a band below that share of the count holds none of the longest stretch and is left
out too, however far an alteration shifts the rest. The other bands are aligned by words: from a shared word on, both ways, the furthest cells
reached with 0, 1, ... alterations, so that no cell is more than the budget of words off the diagonal.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.runtime import table

Q = 8  # length of the q-grams; items of very short words take shorter ones, so that the lemma says something for them
MIN_WORDS = 20  # words of an item in succession that make a passage
MAX_ALTERED = 2  # words of them that may be altered, left out or put in
BAND = 48  # half the width of the bands in which hits are counted
BLOCK_CHARS = 20_000_000  # characters of items that are broadcast; more items meet the documents in a join of fingerprints

_LINE_PREFIX = re.compile(
    r"^[ \t]*(?:(?:[>#*+|;/-]|//+|--)[ \t]*)*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?[ \t]+[\w.@-]{1,40}:[ \t]|\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?[\w.,:+-]*\]?[ \t]*(?:(?:INFO|WARN|ERROR|DEBUG)\b:?)?"
    r"|(?:L|line )?\d{1,6}[ \t]*[|:.)\]][ \t]+)?", re.M | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,300}>")
_LINK = re.compile(r"\]\([^()\s]{1,300}\)")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_ESCAPE = re.compile(r"\\[nrtbfv]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_NOT_WORD = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """A text without markup, escapes, line prefixes, marks on letters and case; white space and punctuation stay."""
    if "&" in text:
        text = html.unescape(text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m.group(0), errors="replace"), text)
    if "\\" in text:
        text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), text)
        text = _ESCAPE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    text = _LINE_PREFIX.sub("", text.replace("\r", "\n"))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.lower()


def squeezed(text: str) -> str:
    """Letters and digits of a text, and nothing between them."""
    return _NOT_WORD.sub("", plain(text))


class Bounds:
    """Places between the words of a squeezed text: words as white space parts them, and pieces as any other sign does."""

    def __init__(self, text: str):
        self.words, self.pieces, at = [0], [0], 0
        for word in plain(text).split():
            for piece in _NOT_WORD.split(word):
                if piece:
                    at += len(piece)
                    self.pieces.append(at)
            if at != self.words[-1]:
                self.words.append(at)
        self.all = frozenset(self.pieces)

    def next(self, at: int, step: int) -> set[int]:
        """Where the next word or piece of the text ends (step 1: after a place; -1: before it)."""
        out = set()
        for b in (self.words, self.pieces):
            i = bisect_right(b, at) if step > 0 else bisect_left(b, at) - 1
            if 0 <= i < len(b):
                out.add(b[i])
        return out

    def glued(self, low: int, high: int) -> bool:
        """Whether nothing parts the words between two places."""
        i = bisect_right(self.pieces, low)
        return i == len(self.pieces) or self.pieces[i] >= high


def item_words(text: str) -> list[str]:
    return [w for w in (_NOT_WORD.sub("", x) for x in plain(text).split()) if w]


def gram_hashes(text: str, q: int = Q) -> np.ndarray:
    """Hash of each q-gram of a text, by its start."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return out ^ (out >> np.uint64(29))


def shared_at_least(words: list[str], q: int = Q) -> np.ndarray:
    """Least number of shared q-grams of each MIN_WORDS words in succession with MAX_ALTERED of them altered (q-gram lemma).

    A passage of n characters has n - q + 1 q-grams; an altered word of length m spoils at most m + q - 1 of them.
    """
    lengths = [len(w) for w in words]
    windows = [lengths[i : i + MIN_WORDS] for i in range(max(1, len(lengths) - MIN_WORDS + 1))]
    return np.array([sum(w) - q + 1 - sum(m + q - 1 for m in sorted(w)[-MAX_ALTERED:]) for w in windows], np.int64)


def gram_length(words: list[str]) -> int:
    """The greatest q up to Q for which the lemma demands a shared q-gram; MIN_WORDS words always have one."""
    return next((q for q in range(Q, 1, -1) if shared_at_least(words, q).min() >= 1), 1)


def share(words: list[str], q: int) -> int:
    """Least number of shared q-grams in a row: those the lemma demands lie in at most MAX_ALTERED + 1 rows."""
    return max(1, -(-int(shared_at_least(words, q).min()) // (MAX_ALTERED + 1)))


SIEVE = 1 << 22  # bits by which most q-grams that no item has are left out at once


class GramIndex:
    """The q-grams of one length of some items."""

    def __init__(self, q: int, numbers: list[int], words: list[list[str]]):
        self.q = q
        grams = [gram_hashes("".join(w), q) for w in words]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners = np.concatenate([np.full(len(g), n, np.int64) for g, n in zip(grams, numbers)])[order]
        self.places = np.concatenate([np.arange(len(g), dtype=np.int64) for g in grams])[order]
        first = np.concatenate([[True], self.hashes[1:] != self.hashes[:-1]])
        self.keys = self.hashes[first]
        self.bounds = np.append(np.flatnonzero(first), len(self.hashes))
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.keys & np.uint64(SIEVE - 1)).astype(np.int64)] = True

    def hits(self, text: str):
        """(item number, item place, document place) of every q-gram that a text shares with an item."""
        h = gram_hashes(text, self.q)
        maybe = np.flatnonzero(self.sieve[(h & np.uint64(SIEVE - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == h[maybe]
        found, at = maybe[same], at[same]
        lo = self.bounds[at]
        counts = self.bounds[at + 1] - lo
        doc = np.repeat(found, counts)
        slots = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        return self.owners[slots], self.places[slots], doc


class ItemIndex:
    """Items by the hashes of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.starts, self.kept = [], [], [], []
        least, by_length = [], {}
        for item_id, text in items:
            words = item_words(text or "")
            if len(words) < MIN_WORDS:
                continue
            q = gram_length(words)
            by_length.setdefault(q, []).append(len(self.ids))
            least.append(share(words, q))
            self.ids.append(item_id)
            self.words.append(words)
            starts = np.cumsum([0, *map(len, words)])
            self.starts.append(starts.tolist())
            self.kept.append((shared_at_least(words, q), starts[: len(words) - MIN_WORDS + 1], np.maximum(starts[MIN_WORDS:] - q + 1, starts[: len(words) - MIN_WORDS + 1])))
        self.share = np.array(least, np.int64)
        self.least = np.array([max(1, kept.min()) for kept, _, _ in self.kept], np.int64)
        self.grams = [GramIndex(q, numbers, [self.words[n] for n in numbers]) for q, numbers in sorted(by_length.items())]

    def passes(self, k: int, places: np.ndarray) -> bool:
        """Whether the lemma allows a passage of item k of which these places are shared, on whatever diagonals."""
        kept, begin, end = self.kept[k]
        shared = np.zeros(self.starts[k][-1] + 1, np.int64)
        shared[places + 1] = 1
        upto = np.cumsum(shared)
        return bool((upto[end] - upto[begin] >= kept).any())

    def bands(self, text: str):
        """(item number, pairs of item place and document place) of the bands that meet the lemma."""
        for grams in self.grams:
            if len(text) < grams.q:
                continue
            item, place, doc = grams.hits(text)
            if not len(item):
                continue
            diagonal = doc - place
            per_item = np.bincount(item, minlength=len(self.ids))
            for k in np.flatnonzero(per_item >= self.least):
                mine = item == k
                if not self.passes(k, place[mine]):
                    continue
                d, p, q = diagonal[mine], place[mine], doc[mine]
                # overlapping bands of 2 * BAND: each hit is in two of them
                band = np.floor_divide(d, BAND)
                ids, inverse = np.unique(np.concatenate([band, band + 1]), return_inverse=True)
                sizes = np.bincount(inverse)
                both = np.concatenate([np.arange(len(d)), np.arange(len(d))])
                for b in np.flatnonzero(sizes >= self.share[k]):
                    at_band = np.unique(both[inverse == b])
                    order = at_band[np.argsort(p[at_band], kind="stable")]
                    yield int(k), p[order], q[order]


def _reach(words: list[str], text: str, j: int, p: int, step: int, bounds: Bounds) -> list[int]:
    """Item words passed from word j on (step 1: rightwards from text place p; -1: leftwards to it), by alterations 0..MAX_ALTERED.

    An alteration is a word replaced, left out or put in. The front of u alterations is what is reached with exactly u; each of its cells
    (item word, text place) slides along words that agree. An altered word at the end counts where the text has a word in its place. Where
    the text does not part its words, an altered one has any length: it ends where the following words of the item, Q characters of them at least, are found
    before the next sign, or after as many characters as the item's word.
    """
    best = [0] * (MAX_ALTERED + 1)
    stop = len(words) if step > 0 else -1

    def slide(k, at, u):
        """(words passed, place) where the words that agree from a cell on end."""
        began, whole, start = at, None, k
        while k != stop:
            w = words[k]
            if step > 0:
                if not text.startswith(w, at):
                    break
                at += len(w)
            else:
                if at < len(w) or not text.startswith(w, at - len(w)):
                    break
                at -= len(w)
            k += step
            if at in bounds.all:
                whole = k, at
        ends = {(start, began)}
        if k != start:
            # after an alteration a word of the text must end with that of the item, where the text parts its words
            if not u or bounds.glued(min(at, began) - 1, max(at, began) + 1):
                ends.add((k, at))
            if whole:
                ends.add(whole)
        return ends

    def find(k, at):
        """Places before the next sign at which the item goes on from word k."""
        probe, n = "", k
        while n != stop and len(probe) < Q:
            probe = probe + words[n] if step > 0 else words[n] + probe
            n += step
        if len(probe) < Q:
            return
        ahead = bounds.next(at, step)
        edge = (min if step > 0 else max)(ahead, default=len(text) if step > 0 else 0)
        lo, hi = (at + 1, edge) if step > 0 else (edge, at - 1)
        q = text.find(probe, max(lo, 0), hi)
        while q >= 0:
            yield q if step > 0 else q + len(probe)
            q = text.find(probe, q + 1, hi)

    front = {(j, p, 0)}  # item word, text place, words that count where the passage ends here
    for u in range(MAX_ALTERED + 1):
        if u:
            best[u] = best[u - 1]
        after = set()
        for k0, at0, counted in front:
            for k, at in slide(k0, at0, u):
                passed = counted if k == k0 else abs(k - j)
                best[u] = max(best[u], passed)
                if u == MAX_ALTERED:
                    continue
                ahead = bounds.next(at, step)
                after.update((k, q, passed) for q in ahead)  # put in
                if k == stop:
                    continue
                after.update((k + step, q, abs(k + step - j)) for q in ahead)  # replaced
                after.add((k + step, at, passed))  # left out
                after.update((k, q, passed) for q in find(k, at))
                if k + step != stop:
                    after.update((k + step, q, passed) for q in find(k + step, at))
                    as_long = at + step * len(words[k])
                    if bounds.glued(min(as_long, at) - 1, max(as_long, at) + 1) and 0 <= as_long <= len(text):
                        after.add((k + step, as_long, passed))
        front = after
    return best


def longest_passage(words: list[str], starts: list[int], text: str, places: np.ndarray, docs: np.ndarray, bounds: Bounds, enough: int | None = None) -> int:
    """Most item words in succession that a text holds on a band, with at most MAX_ALTERED alterations; the first run of `enough` words ends the search."""
    best, done = 0, set()
    for p, q in zip(places.tolist(), docs.tolist()):
        j = bisect_right(starts, p) - 1
        if starts[j] != p:
            j += 1  # anchor at the first word that begins inside the q-gram
            if j >= len(words):
                continue
        at = q + starts[j] - p
        if (j, at) in done or not text.startswith(words[j], at):
            continue
        right = _reach(words, text, j, at, 1, bounds)
        left = _reach(words, text, j - 1, at, -1, bounds)
        best = max(best, max(left[u] + right[MAX_ALTERED - u] for u in range(MAX_ALTERED + 1)))
        if enough is not None and best >= enough:
            return best
        for k in range(right[0]):
            done.add((j + k, at + starts[j + k] - starts[j]))
    return best


def leaked(index: ItemIndex, text: str):
    """(item number, words) of the items of which a text holds a passage, with the most words of one."""
    flat, most, bounds = squeezed(text), {}, None
    for k, places, at in index.bands(flat):
        bounds = bounds or Bounds(text)
        n = longest_passage(index.words[k], index.starts[k], flat, places, at, bounds)
        if n >= MIN_WORDS:
            most[k] = max(n, most.get(k, 0))
    yield from most.items()


_FOUND = StructType([StructField("doc_id", LongType()), StructField("item_id", LongType()), StructField("words", IntegerType())])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): documents that hold a passage of an item.

    docs: doc_id, text; items: item_id, text. words counts the item words of the longest passage (MIN_WORDS at least), altered ones included. An altered word at the
    end of a passage counts where the document has a word in its place. Null texts and items shorter than MIN_WORDS give nothing; a document delivered
    again counts once. Items of at most BLOCK_CHARS characters are broadcast; more of them meet the documents in a join, with the same result.
    """
    items = items.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    base = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    found = _by_broadcast(base, items) if chars <= BLOCK_CHARS else _by_join(base, items)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    bound = docs.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in items.collect()))

    def make():
        index = ItemIndex(bound.value)

        def kernel(doc_id, text):
            for k, n in leaked(index, text):
                yield doc_id, index.ids[k], n

        return kernel

    return map_rows(docs, make, _FOUND)


def fingerprints(text: str, q: int, window: int) -> set[int]:
    """The least hash of each `window` q-grams in a row: texts that share so many in a row share a fingerprint."""
    h = gram_hashes(text, q)
    if len(h) < window:
        return set()
    mixed = h * np.uint64(0xD6E8FEB86659FD93)
    return set(np.unique(np.lib.stride_tricks.sliding_window_view(mixed, window).min(axis=1)).view(np.int64).tolist())


_PRINT = StructType([StructField("id", LongType()), StructField("print", LongType())])
_SHARE = StructType([StructField("q", IntegerType()), StructField("share", IntegerType())])


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of any number: pairs that share a fingerprint are verified.

    The longest unaltered stretch of a passage has a run of as many q-grams as `share` says, so no pair is lost.
    """
    def lengths():
        def kernel(text):
            words = item_words(text)
            if len(words) >= MIN_WORDS:
                q = gram_length(words)
                yield q, share(words, q)
        return kernel

    kinds = [tuple(r) for r in map_rows(items.select("text"), lengths, _SHARE).groupBy("q").agg(F.min("share").alias("share")).collect()]  # a row for each length of q-grams
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for q, window in kinds:
        def prints(of_items, q=q, window=window):
            def make():
                def kernel(id_, text):
                    words = item_words(text) if of_items else None
                    if words is None or (len(words) >= MIN_WORDS and gram_length(words) == q):
                        for f in fingerprints("".join(words) if of_items else squeezed(text), q, window):
                            yield id_, f
                return kernel
            return make

        of_items = map_rows(items, prints(True), _PRINT).select(F.col("id").alias("item_id"), "print").distinct()
        of_docs = map_rows(docs, prints(False), _PRINT).select(F.col("id").alias("doc_id"), "print").distinct()
        pairs = of_docs.join(of_items, "print").select("doc_id", "item_id").distinct()

        def verify():
            def kernel(doc_id, text, item_id, item):
                for _, n in leaked(ItemIndex([(item_id, item)]), text):
                    yield doc_id, item_id, n
            return kernel

        both = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "text", "item_id", "item")
        out = out.unionByName(map_rows(both, verify, _FOUND))
    return out


def leaked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))

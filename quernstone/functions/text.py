"""Tokens, n-grams and windows of text as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Between the words of an n-gram.
GRAM_SEP = "\u0001"
#: Around a token whose character n-grams are taken.
LEFT, RIGHT = "⟬", "⟭"
#: Fixed value: runs of operator characters, or single brackets and separators.
PUNCTUATION = r"[=<>!:+\-*/%&|^~.?]{1,4}|[()\[\]{}.,;:]"


def _split(text: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", " "), "([A-Z])", " $1")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def split_identifier(text: Column) -> Column:
    """Lower-case parts of an identifier: split at other than ASCII letters and digits, and before capitals."""
    return F.transform(_split(text), lambda t: F.lower(t))


_CAPITALS = [bytes([c]) for c in range(ord("A"), ord("Z") + 1)]
_OTHERS = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def identifier_words(text: str) -> list[str]:
    """What split_identifier gives, within a Python kernel."""
    raw = text.encode().translate(_OTHERS)
    for c in _CAPITALS:
        raw = raw.replace(c, b" " + c.lower())
    return raw.decode("ascii").split()


def split_keep_case(text: Column) -> Column:
    """Parts of an identifier in their case."""
    return _split(text)


def punctuation(text: Column, most: int = 20_000) -> Column:
    """Operators of up to four characters and single brackets, the first `most`."""
    return F.slice(F.regexp_extract_all(text, F.lit(f"({PUNCTUATION})"), F.lit(1)), 1, most)


def token_ngrams(tokens: Column, low: int = 2, high: int = 4, sep: str = GRAM_SEP) -> Column:
    """All n-grams of `low` to `high` words, in order of n, then place."""
    none = F.array().cast("array<string>")
    parts = [F.when(F.size(tokens) >= n, _grams(tokens, n, sep)).otherwise(none) for n in range(low, high + 1)]
    return F.concat(*parts)


def _grams(tokens: Column, n: int, sep: str) -> Column:
    def at(i):
        return F.array_join(F.slice(tokens, i, F.lit(n)), sep)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), at)


def char_ngrams(token: Column, n: int = 3) -> Column:
    """Character n-grams of a token between its sentinels; a token shorter than that has none."""
    wrapped = F.concat(F.lit(LEFT), token, F.lit(RIGHT))

    def at(i):
        return F.substring(wrapped, i, F.lit(n))
    return F.when(F.length(wrapped) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(wrapped) - (n - 1), F.lit(1))), at)).otherwise(F.array().cast("array<string>"))


def retained(tokens: Column, mode: str, sample: int = 32) -> Column:
    """Tokens kept with a chunk: all (full), the first `sample` (sample), or none."""
    if mode == "full":
        return tokens
    return F.slice(tokens, 1, sample) if mode == "sample" else F.array().cast("array<string>")


def line_count(text: Column) -> Column:
    """Lines of a text; one line feed at its very end begins no line."""
    return F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def windows(text: Column, size: int) -> Column:
    """Array of (start, end) of consecutive windows of `size` characters; empty for an empty text."""
    last = F.length(text)

    def at(s):
        return F.struct(s.alias("start"), F.least(s + size, last).alias("end"))
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)), F.lit(size)), at)).otherwise(
        F.array().cast("array<struct<start:int,end:int>>"))

"""English stems (the published Porter2 rules)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from quernstone.arrow import map_rows

# Fixed values of the published algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = [("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
         ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"(?:gener|commun|arsen)", w)
    first = m.end() if m else None
    if first is None:
        m = re.search(r"[aeiouy][^aeiouy]", w)
        first = m.end() if m else len(w)
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, first)
    return first, m.end() if m else len(w)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w))


def stem(word: str) -> str:
    """The stem of a lower-case English word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in IRREGULAR:
        return IRREGULAR[w]
    if w in UNCHANGED:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w.lower()
    m = re.search(r"(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short(w, min(r1, len(w)) if r1 <= len(w) else r1):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    for end, to in STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, to in STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_token(token: str, least: int = 4, kept: int = 3) -> str:
    """The stem of a Latin token of enough letters; where that would be too short, the token."""
    if len(token) < least or not re.fullmatch(r"[a-z']+", token):
        return token
    s = stem(token)
    return s if len(s) >= kept else token


_STEMS = StructType([StructField("token", StringType()), StructField("stem", StringType())])


def stemmed(tokens: DataFrame) -> DataFrame:
    """(token, stem) of tokens."""
    def make():
        def kernel(token):
            yield token, stem_token(token)
        return kernel

    return map_rows(tokens.select("token"), make, _STEMS)

"""Filters over chunks as conditions: all filters must hold, of a list within one filter any."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from quernstone.functions.paths import extension, normal_path

# Names of languages by what people write for them.
LANGUAGE_GROUPS = {
    "javascript": "javascript js node", "typescript": "typescript ts tsx", "python": "python py", "rust": "rust rs", "go": "go golang", "kotlin": "kotlin kt", "csharp": "csharp c#",
    "ruby": "ruby rb", "shell": "shell bash zsh", "clike": "clike c cpp c++ objective-c objc objective-c++", "starlark": "starlark bazel", "jinja": "jinja jinja2 django", "protobuf": "protobuf",
}
LANGUAGE = {alias: name for name, aliases in LANGUAGE_GROUPS.items() for alias in aliases.split()}


class Impossible(Exception):
    """Filters that exclude each other."""


def values(raw: str | list[str] | None) -> list[str]:
    """The entries of a list filter, split at commas and white space."""
    if raw is None:
        return []
    items = raw if isinstance(raw, list) else re.split(r"[,\s]+", raw)
    return [x.strip() for x in items if x and x.strip()]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def _true(c: Column) -> Column:
    """A missing value is no match."""
    return F.coalesce(c, F.lit(False))


def safe_pattern(pattern: str) -> bool:
    """Whether a pattern, of any length, can be matched in bounded time: no back references, look-arounds or repeated repetitions, and valid."""
    if re.search(r"\\[1-9]|\(\?[=!<]|\([^)]*[+*][^)]*\)[+*]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def path_matches(path: Column, needles: list[str]) -> Column:
    """Substring of the normalised path, without case; or /pattern/flags, which falls back to a substring where it is not safe."""
    found = []
    for n in needles:
        m = re.fullmatch(r"/(.+)/([gims]*)", n)
        if m and safe_pattern(m.group(1)):
            flags = "".join(f for f in m.group(2) if f in "ims")
            found.append(_true(path.rlike((f"(?{flags})" if flags else "") + m.group(1))))
        else:
            found.append(_true(F.lower(normal_path(path)).contains(re.sub(r"^(?:\.?/)+", "", n.replace("\\", "/").lower()))))
    return _any(found)


def ext_matches(ext: Column, path: Column, wanted: list[str]) -> Column:
    names = ["." + w.lower().lstrip("*").lstrip(".") for w in wanted]
    known = F.lower(F.trim(ext))
    known = F.when(known.isNull() | (known == ""), F.concat(F.lit("."), extension(F.trim(path)))).when(known.startswith("."), known).otherwise(F.concat(F.lit("."), known))
    return _true(known.isin(names))


def language(lang: Column) -> Column:
    """The canonical name of a language, `unknown` where it is missing."""
    name = F.lower(F.trim(lang))
    mapped = F.create_map(*[F.lit(x) for pair in LANGUAGE.items() for x in pair])
    return F.coalesce(mapped[name], name, F.lit("unknown"))


def lang_matches(lang: Column, wanted: list[str]) -> Column:
    return language(lang).isin([LANGUAGE.get(w.lower(), w.lower()) for w in wanted])


def contains_any(column: Column, needles: list[str]) -> Column:
    """Substring without case of a text."""
    return _any([_true(F.lower(column).contains(n.lower())) for n in needles])


def list_contains(column: Column, needles: list[str]) -> Column:
    """Substring without case of any entry of a list."""
    return _true(F.exists(column, lambda x: _any([F.coalesce(F.lower(x).contains(n.lower()), F.lit(False)) for n in needles])))


def has_member(column: Column, names: list[str], fold: bool = True) -> Column:
    """An entry of a list that equals one of names."""
    if fold:
        return _true(F.arrays_overlap(F.transform(column, lambda x: F.lower(x)), F.array(*[F.lit(n.lower()) for n in names])))
    return _true(F.arrays_overlap(column, F.array(*[F.lit(n) for n in names])))


def has_items(column: Column) -> Column:
    """A list that is not empty, as of lint messages."""
    return _true(F.size(column) > 0)


def flow_matches(flows: Column, needles: list[str]) -> Column:
    """A flow (struct of source and sink) whose `source->sink` contains any of needles, without case."""
    return _true(F.exists(flows, lambda f: _any([F.coalesce(F.lower(F.concat(f["source"], F.lit("->"), f["sink"])).contains(n.lower()), F.lit(False)) for n in needles])))


def structural_matches(entries: Column, pack: str | None = None, rule: str | None = None, tag: str | None = None) -> Column:
    """One structural entry (pack, rule, tags) that satisfies all that is given."""
    def one(e):
        out = F.lit(True)
        if pack:
            out = out & F.coalesce(F.lower(e["pack"]).contains(pack.lower()), F.lit(False))
        if rule:
            out = out & F.coalesce(F.lower(e["rule"]).contains(rule.lower()), F.lit(False))
        if tag:
            out = out & F.coalesce(F.exists(e["tags"], lambda t: F.lower(t).contains(tag.lower())), F.lit(False))
        return out
    return _true(F.exists(entries, one))


def meta_matches(payload: Column, key: str, value: str | None) -> Column:
    """A dotted path of a JSON text that is there and not empty, or holds a text without case."""
    found = F.get_json_object(payload, "$." + key)
    if value is None:
        return _true((found.isNotNull()) & ~found.isin("", "[]", "{}", "null"))
    return _true(F.lower(found).contains(value.lower()))


def modified(at: Column, after: str | None = None, since_days: int | None = None, now: Column | None = None) -> Column:
    """Not before `after`, nor more than `since_days` before now."""
    bounds = []
    if after is not None:
        bounds.append(F.lit(after).cast("timestamp"))
    if since_days is not None:
        bounds.append((now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(since_days)} DAYS"))
    return _true(at >= (bounds[0] if len(bounds) == 1 else F.greatest(*bounds))) if bounds else F.lit(True)


def parsed_time(text: Column) -> Column:
    """A timestamp from its many forms: ISO with or without zone, minutes only, epoch seconds or milliseconds; else null."""
    t = F.trim(text)
    iso = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"Z$", "+00:00"), r"^(\d{4}-\d\d-\d\d) (\d\d:\d\d)", "$1T$2"))
    epoch = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.cast("long"))).when(t.rlike(r"^\d{12,13}$"), F.timestamp_millis(t.cast("long")))
    return F.coalesce(epoch, iso)


@dataclass
class Parsed:
    """A filter expression: lists by key, and what was wrong with it."""

    file: list[str] = field(default_factory=list)
    lang: list[str] = field(default_factory=list)
    ext: list[str] = field(default_factory=list)
    type: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


_KEYS = {"file": "file", "path": "file", "lang": "lang", "language": "lang", "ext": "ext", "extension": "ext", "type": "type", "kind": "type"}


def parse_expression(raw: str | None) -> Parsed:
    """`key:value` and `key=value` tokens, quoted or bare; a token without a key names a file."""
    out = Parsed()
    for m in re.finditer(r'"([^"]*)"|\'([^\']*)\'|(\S+)', raw or ""):
        token = next(g for g in m.groups() if g is not None).strip()
        if not token:
            continue
        at = re.search(r"[:=]", token)
        if at is None or re.match(r"[A-Za-z]:[\\/]", token):
            out.file += [v.strip() for v in token.split(",") if v.strip()]
            continue
        key, value = token[: at.start()].strip().lower(), token[at.end() :].strip()
        if not value:
            out.errors.append(f"missing value for {key}")
        elif key not in _KEYS:
            out.errors.append(f"unknown filter key {key}")
        else:
            getattr(out, _KEYS[key]).extend(v.strip() for v in value.split(",") if v.strip())
    return out


def meet(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The entries both lists have; a missing list sets no bound. Raises Impossible where nothing is left."""
    if not a or not b:
        return a or b or None
    both = [x for x in a if x in set(b)]
    if not both:
        raise Impossible(f"{a} and {b}")
    return both


def expression_condition(parsed: Parsed, *, file: Column, ext: Column, lang: Column, kind: Column, more: Parsed | None = None) -> Column:
    """The condition of an expression, met with another's lists; one that can never hold is a false literal, which empties the plan."""
    more = more or Parsed()
    try:
        files, exts, langs, kinds = (meet(getattr(parsed, k), getattr(more, k)) for k in ("file", "ext", "lang", "type"))
    except Impossible:
        return F.lit(False)
    out = F.lit(True)
    if files:
        out = out & path_matches(file, files)
    if exts:
        out = out & ext_matches(ext, file, exts)
    if langs:
        out = out & lang_matches(lang, langs)
    if kinds:
        out = out & _true(F.lower(kind).isin([k.lower() for k in kinds]))
    return out

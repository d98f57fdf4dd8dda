"""Source files that are not valid in the language of their extension.

A file is first brought into its shape: literals, identifiers and numbers become one character each, comments go. Lines
of shapes recur, within a file and between files, so the step of the recognizer over a whole line is remembered too.
The full token stream is parsed; the first token that no stack can take, or the end reached too early, is the error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quernstone.arrow import map_rows
from quernstone.functions.paths import extension
from quernstone.llm import grammars
from quernstone.llm.glr import Grammar, Recognizer, build_tables

# Language of an extension.
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "py": "python", "go": "go", "rs": "rust", "c": "c", "h": "c", "json": "json"}

BAD = "\x00"  # what no token of the language begins with
OPEN, CLOSE = "\x02", "\x03"  # around an expression inside a literal
DROPPED = "\x04"  # a line break inside a literal or comment

_CONTROL = r"[\x00-\x08\x0e-\x1f\x7f]"


def _quoted(q: str, escape: str = r"\\[\s\S]", lines: bool = False) -> str:
    plain = rf"[^{q}\\]*" if lines else rf"[^{q}\\\n]*"
    return rf"{q}{plain}(?:{escape}{plain})*{q}"


class Words(dict):
    """Class of each word or number; remembers what it has seen, within a bound."""

    def __init__(self, keywords, number: re.Pattern, verify=None):
        super().__init__({k: k for k in keywords})
        self.number, self.verify = number, verify

    def __missing__(self, word):
        if word[0].isdigit() or word[0] == "." or word[0] == "-":
            kind = "0" if self.number.fullmatch(word) and (self.verify is None or self.verify(word)) else BAD
            if word[0] == ".":
                kind = " " + kind  # a keyword may stand right before it
        else:
            kind = "a"
        if len(self) < 100_000:
            self[word] = kind
        return kind


class Language:
    """Lexis and grammar of a language, with a recognizer that keeps what it has learned."""

    grammar: str
    start: str
    keywords: list[str] = []
    skip: re.Pattern
    number = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][-+]?[\d_]+)?|\.\d[\d_]*(?:[eE][-+]?[\d_]+)?"
    suffix = ""
    letters = r"[^\W\d]"
    more = r"\w"
    operators: dict[str, str] = {}
    verify = None

    def __init__(self, tables: dict):
        self.recognizer = Recognizer(tables)
        number = f"(?:{self.number})(?:{self.suffix})?" if self.suffix else f"(?:{self.number})"
        self.words = Words(self.keywords, re.compile(number), type(self).verify)
        self.word = re.compile(rf"{number}(?!{self.more})|\d{self.more}*|{self.letters}{self.more}*")
        ops = sorted(self.operators, key=len, reverse=True)
        self.token = re.compile("|".join([r"[A-Za-z_]\w*", *map(re.escape, ops), r"\S"]))
        self.kinds: dict[str, tuple[str, ...]] = {}

    # shape -------------------------------------------------------------------------------------------------------
    def strip(self, text: str, keep: bool = False) -> str:
        """text with literals as one character each and without comments."""
        out, at, search = [], 0, self.skip.search
        while True:
            m = search(text, at)
            if m is None:
                out.append(text[at:])
                return "".join(out)
            out.append(text[at : m.start()])
            piece, end = self.literal(text, m, keep)
            out.append(piece)
            if keep:
                n = text.count("\n", m.start(), end) - piece.count("\n")
                if n > 0:
                    out.append(DROPPED * n)
            at = end

    def literal(self, text: str, m: re.Match, keep: bool) -> tuple[str, int]:
        raise NotImplementedError

    def shape(self, text: str, keep: bool = False) -> str:
        table = self.words
        return self.word.sub(lambda m: table[m.group()], self.strip(text, keep))

    def tokens(self, line: str) -> tuple[str, ...]:
        found = self.kinds.get(line)
        if found is None:
            get = self.operators.get
            found = tuple(get(t, t) for t in self.token.findall(line))
            if len(self.kinds) < 100_000:
                self.kinds[line] = found
        return found

    # parse -------------------------------------------------------------------------------------------------------
    def line(self, config: int, line: str) -> int:
        step = self.recognizer.step
        for t in self.tokens(line):
            config = step(config, t)
            if config < 0:
                return -1
        return config

    def finish(self, config: int) -> bool:
        return self.recognizer.accepts(config)

    def empty_is_valid(self) -> bool:
        return True

    def first_error(self, text: str) -> int | None:
        """One-based line of the first error that no continuation mends; None for valid texts."""
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        if not text.strip():
            return None if self.empty_is_valid() else 1
        if self.recognizer.full():
            self.recognizer.reset()
        memory, config = self.recognizer.memory, 0
        lines = self.shape(text).split("\n")
        for k, raw in enumerate(lines):
            line = raw.strip()
            if not line:
                continue
            key = (config, line)
            after = memory.get(key)
            if after is None:
                after = memory[key] = self.line(config, line)
            if after < 0:
                return self.real_line(text, k)
            config = after
        return None if self.finish(config) else text.count("\n") + 1

    def real_line(self, text: str, k: int) -> int:
        """One-based line of the text that line k of its shape comes from."""
        before = self.shape(text, keep=True).split("\n")[: k + 1]
        return k + 1 + sum(x.count(DROPPED) for x in before[:k])


def _classes(**groups: str) -> dict[str, str]:
    """Operators, given as words, by their token class."""
    return {op: kind for kind, ops in groups.items() for op in ops.split()}


class Json(Language):
    grammar, start = grammars.JSON, "Text"
    keywords = ["true", "false", "null"]
    number = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?"
    skip = re.compile(r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"|"|' + _CONTROL + "|\x0b|\x0c|\xa0|\ufeff|[\u2000-\u200b\u2028\u2029\u3000]")

    def literal(self, text, m, keep):
        return ('"' if len(m.group()) > 1 else BAD), m.end()

    def empty_is_valid(self):
        return False


class EcmaScript(Language):
    letters, more = r"(?:[^\W\d]|\$)", r"[\w$]"
    suffix = "n"
    skip = re.compile(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|" + _quoted('"') + "|" + _quoted("'") + r"|[\"'`]|" + _CONTROL
        + r"|(?:(?<=[(,=:\[!&|?{};+*~^<>%\n\t-])|(?<=[(,=:\[!&|?{};+*~^<>%-] )|(?<=\breturn)|(?<=\breturn )|(?<=\btypeof)|(?<=\btypeof )|(?<=\bcase )|(?<=  )|(?<![\s\S]))/(?![*/])[^/\\\[\n]*(?:(?:\\.|\[[^\]\\\n]*(?:\\.[^\]\\\n]*)*\])[^/\\\[\n]*)*/[a-z]*")
    code = re.compile(skip.pattern + "|[{}]")
    plain_ops = "=== !== == != <= >= && || ?? / % ** ^ <<"

    def literal(self, text, m, keep):
        g = m.group()
        c = g[0]
        if c == "/":
            if g.startswith("//"):
                return "", m.end()
            if g == "/*":
                return BAD, len(text)
            if g.startswith("/*"):
                return ("\n" if "\n" in g else " "), m.end()
            return '"', m.end()
        if c == "`":
            return self.template(text, m.start(), keep)
        return ('"' if len(g) > 1 else BAD), m.end()

    _IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")

    def template(self, text, start, keep):
        """Shape and end of a template literal: a mark, then each of its expressions.

        One pass over the text, however deep templates lie within expressions of others: `nested` has 0 for an open template and
        the number of open braces for an open expression.
        """
        out, nested, at = ["`"], [0], start + 1
        while nested:
            m = (self.code if nested[-1] else self._IN_TEMPLATE).search(text, at)
            if m is None:
                return BAD, len(text)
            g = m.group()
            if not nested[-1]:
                at = m.end()
                if g == "`":
                    nested.pop()
                elif g == "${":
                    out.append(OPEN)
                    nested.append(1)
                continue
            out.append(text[at : m.start()].replace("\n", " "))
            at = m.end()
            if g == "`":
                out.append(g)
                nested.append(0)
            elif g == "{":
                out.append(g)
                nested[-1] += 1
            elif g == "}":
                nested[-1] -= 1
                if nested[-1]:
                    out.append(g)
                else:
                    out.append(CLOSE)
                    nested.pop()
            else:
                piece, at = self.literal(text, m, False)
                out.append(piece.replace("\n", " "))
        return "".join(out), at

    def strip(self, text, keep=False):
        return super().strip("//" + text[2:] if text.startswith("#!") else text, keep)

    def line(self, config, line):
        step = self.recognizer.step
        for i, t in enumerate(self.tokens(line)):
            # a semicolon that is left out at a line's end, or before a closing brace
            if i == 0 and t == "++":
                ended = step(config, "ASI")
                after = step(ended, t) if ended >= 0 else -1
                after = after if after >= 0 else step(config, t)
            else:
                after = step(config, t)
                if after < 0 and (i == 0 or t == "}"):
                    ended = step(config, "ASI")
                    after = step(ended, t) if ended >= 0 else -1
            if after < 0:
                return -1
            config = after
        return config

    def finish(self, config):
        if self.recognizer.accepts(config):
            return True
        ended = self.recognizer.step(config, "ASI")
        return ended >= 0 and self.recognizer.accepts(ended)


class JavaScript(EcmaScript):
    grammar, start, keywords = grammars.JAVASCRIPT, "Program", grammars.JS_KEYWORDS
    operators = {
        **_classes(op=EcmaScript.plain_ops + " & |", **{"+-": "+ -", "++": "++ --", "!": "! ~", "op=": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="}),
        **{t: t for t in ("=>", "...", "?.", ">", "<", "=")}, OPEN: "<<", CLOSE: ">>", "?.0": "?.0",
    }


class TypeScript(EcmaScript):
    grammar, start, keywords = grammars.TYPESCRIPT, "Program", grammars.TS_KEYWORDS
    operators = {
        **_classes(op=EcmaScript.plain_ops, **{"+-": "+ -", "++": "++ --", "!": "! ~", "op=": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="}),
        **{t: t for t in ("=>", "...", "?.", ">", "<", "=", "&", "|")}, OPEN: "<<", CLOSE: ">>",
    }


class Python(Language):
    grammar, start, keywords = grammars.PYTHON, "File", grammars.PY_KEYWORDS
    number = (r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
              r"|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?")
    skip = re.compile(r"#[^\n]*|\\\n|(?:(?<!\w)(?:[bB][rR]?|[rR][bBfF]?|[uU]|[fF][rR]?))?(?:\"\"\"|'''|\"|')|`|" + _CONTROL)
    bodies = {
        '"""': re.compile(r'[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""'), "'''": re.compile(r"[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''"),
        '"': re.compile(r'[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'), "'": re.compile(r"[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"),
    }
    operators = {
        **_classes(op="// % << >> & ^", cmp="== != < > <= >=", **{"+-": "+ -", "op=": "+= -= *= /= //= %= **= <<= >>= &= |= ^= @="}),
        **{t: t for t in ("**", "->", ":=", "...", "=", "*", "/")}, "`": "F", OPEN: "<<", CLOSE: ">>",
    }

    @staticmethod
    def verify(word):
        return not re.fullmatch(r"0[\d_]*[1-9][\d_]*", word)

    def literal(self, text, m, keep):
        g = m.group()
        if g[0] == "#":
            return "", m.end()
        if g[0] == "\\":
            return " ", m.end()
        quote = g.lstrip("rRbBuUfF")
        if quote not in self.bodies:
            return BAD, m.end()
        if "f" in g[: -len(quote)].lower():
            return self.formatted(text, m.end(), quote, g)
        body = self.bodies[quote].match(text, m.end())
        if body is None:
            return BAD, len(text) if len(quote) == 3 else m.end()
        return '"', body.end()

    code = re.compile(skip.pattern + r"|!=|[()\[\]{}:!]")
    # what ends a run of literal characters: escapes, braces, the closing quote, and a line's end where one may not be
    parts = {(q, raw): re.compile((r"" if raw else r"\\N\{[^{}\n]*\}|") + r"\\[^{}]|[{}]|" + q + (r"" if len(q) == 3 else r"|\n"))
             for q in ('"""', "'''", '"', "'") for raw in (False, True)}
    _CONVERSION = re.compile(r"[rsa]\s*(?=[:}])")

    def formatted(self, text, start, quote, opening):
        """Shape and end of a formatted string: a mark, then each of its expressions, those of format specifications after that which they format.

        One pass, however deep strings lie within expressions of others. `nested` holds what is open: literal text, code with its open
        brackets, or a format specification; each with the quote and the rawness of its string.
        """
        broken = BAD, (len(text) if len(quote) == 3 else start)
        out, at, nested = ["`"], start, [["text", quote, "r" in opening[: -len(quote)].lower(), 0]]
        while nested:
            kind, q, raw, depth = top = nested[-1]
            m = (self.code if kind == "code" else self.parts[q, raw]).search(text, at)
            if m is None:
                return broken
            g = m.group()
            if kind != "code":
                at = m.end()
                if g[0] == "\\":
                    continue
                if kind == "text" and g in "{}" and text.startswith(g, at):
                    at += 1  # a doubled brace is a character
                elif g == "{":
                    out.append(OPEN)
                    nested.append(["code", q, raw, 0])
                elif g == "}" and kind == "spec" or g == q and kind == "text":
                    nested.pop()
                elif g == "\n" and kind == "spec":
                    continue
                else:
                    return broken
                continue
            out.append(text[at : m.start()].replace("\n", " "))
            at = m.end()
            if g in ("(", "[", "{"):
                top[3] += 1
                out.append(g)
            elif depth and g in (")", "]", "}"):
                top[3] -= 1
                out.append(g)
            elif not depth and g in ("}", ":", "!"):
                if g == "!":
                    conversion = self._CONVERSION.match(text, at)
                    if conversion is None:
                        return broken
                    at = conversion.end() + 1
                    g = text[at - 1]
                out.append(CLOSE)
                nested.pop()
                if g == ":":
                    nested.append(["spec", q, raw, 0])
            elif g[-1] in "\"'":
                inner = g[-3:] if g[-3:] in self.bodies else g[-1]
                prefix = g[: -len(inner)].lower()
                if "f" in prefix:
                    out.append("`")
                    nested.append(["text", inner, "r" in prefix, 0])
                else:
                    body = self.bodies[inner].match(text, at)
                    if body is None:
                        return broken
                    out.append('"')
                    at = body.end()
            elif g[0] == "\\":
                out.append(" ")
            elif g[0] != "#":
                out.append(g if g in ("!=", ":", "!", ")", "]") else BAD)
        return "".join(out), at

    def first_error(self, text):
        text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        if not text.strip():
            return None
        if self.recognizer.full():
            self.recognizer.reset()
        memory, state = self.recognizer.memory, (0, (0,), (0,), 0)
        for k, line in enumerate(self.shape(text).split("\n")):
            if not line or line.isspace():
                continue
            key = (state, line)
            after = memory.get(key)
            if after is None:
                after = memory[key] = self.physical(state, line) or -1
            if after == -1:
                return self.real_line(text, k)
            state = after
        config, wide, narrow, depth = state
        if depth:
            return text.count("\n") + 1
        for _ in wide[1:]:
            config = self.recognizer.step(config, "OUT")
        return None if config >= 0 and self.recognizer.accepts(config) else text.count("\n") + 1

    def physical(self, state, line):
        """State after a line: configuration, indentation with tabs of 8 and of 1, open brackets; None for an error."""
        config, wide, narrow, depth = state
        step = self.recognizer.step
        if not depth:
            lead = line[: len(line) - len(line.lstrip())].rpartition("\f")[2]
            w, s = len(lead.expandtabs(8)), len(lead)
            if w > wide[-1]:
                if s <= narrow[-1]:
                    return None
                wide, narrow = (*wide, w), (*narrow, s)
                config = step(config, "IN")
            else:
                while w < wide[-1] and config >= 0:
                    wide, narrow = wide[:-1], narrow[:-1]
                    config = step(config, "OUT")
                if w != wide[-1] or s != narrow[-1]:
                    return None
            if config < 0:
                return None
        for t in self.tokens(line):
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            config = step(config, t)
            if config < 0:
                return None
        if not depth:
            config = step(config, "NL")
            if config < 0:
                return None
        return config, wide, narrow, depth


class Go(Language):
    grammar, start, keywords = grammars.GO, "File", grammars.GO_KEYWORDS
    number = r"0[xX][\da-fA-F_.]+(?:[pP][-+]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*\.?[\d_]*(?:[eE][-+]?[\d_]+)?|\.\d[\d_]*(?:[eE][-+]?[\d_]+)?"
    suffix = "i"
    _escape = r"\\(?:[abfnrtv\\%s]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
    skip = re.compile(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|" + _quoted('"', _escape % '"') + r"|`[^`]*`|'(?:[^'\\\n]|" + _escape % "'" + r")'|[\"'`]|" + _CONTROL)
    operators = {
        **_classes(op="/ % << >> &^ == != < <= > >= && ||", **{"+-": "+ -", "++": "++ --", "op=": "+= -= *= /= %= &= |= ^= <<= >>= &^="}),
        **{t: t for t in ("<-", ":=", "...", "=", "*", "&", "|", "^", "!", "~")},
    }
    ends = frozenset(["a", "0", '"', ")", "]", "}", "++", "return", "break", "continue", "fallthrough"])

    def literal(self, text, m, keep):
        g = m.group()
        if g.startswith("//"):
            return "", m.end()
        if g == "/*":
            return BAD, len(text)
        if g.startswith("/*"):
            return ("\n" if "\n" in g else " "), m.end()
        return ('"' if len(g) > 1 else BAD), m.end()

    def tokens(self, line):
        found = self.kinds.get(line)
        if found is None:
            found = super().tokens(line)
            if found and found[-1] in self.ends:
                found = self.kinds[line] = (*found, ";")
        return found


class Rust(Language):
    grammar, start, keywords = grammars.RUST, "File", [*grammars.RUST_KEYWORDS, "_"]
    number = r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]+|\.(?![\w.]))?(?:[eE][-+]?[\d_]+)?"
    suffix = r"_?(?:[iu](?:8|16|32|64|128|size)|f32|f64)"
    _escape = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|\s)"
    skip = re.compile(
        r"//[^\n]*|/\*|(?<!\w)(?:b|c)?r#*\"|(?<!\w)r#(?=[A-Za-z_])|(?:(?<!\w)[bc])?" + _quoted('"', _escape, True) + r"|(?:(?<!\w)b)?'(?:[^'\\\n]|" + _escape + r")'|'[^\W\d]\w*(?!')|[\"'`]|" + _CONTROL)
    operators = {
        **_classes(op="/ % ^ << == != <=", **{"+-": "-", "op=": "+= -= *= /= %= ^= &= |= <<="}),
        **{t: t for t in ("..", "..=", "...", "::", "->", "=>", ">=", "&&", "||", "=", "+", "*", "&", "|", "<", ">", "!")}, "'": "life",
    }

    def literal(self, text, m, keep):
        g = m.group()
        if g.startswith("//"):
            return "", m.end()
        if g == "/*":
            depth, i = 1, m.end()
            mark = re.compile(r"/\*|\*/")
            while depth:
                n = mark.search(text, i)
                if n is None:
                    return BAD, len(text)
                depth += 1 if n.group() == "/*" else -1
                i = n.end()
            return " ", i
        if g.endswith('#"') or g in ('r"', 'br"', 'cr"'):
            close = text.find('"' + "#" * g.count("#"), m.end())
            return ('"', close + 1 + g.count("#")) if close >= 0 else (BAD, len(text))
        if g == "r#":
            return "", m.end()
        if g[0] == "'" and g[-1] != "'":
            return "'", m.end()
        return ('"' if len(g) > 1 else BAD), m.end()


class C(Language):
    grammar, start, keywords = grammars.C, "Unit", grammars.C_KEYWORDS
    number = r"0[xX][\da-fA-F']*\.?[\da-fA-F]*(?:[pP][-+]?\d+)?|0[bB][01']+|\d[\d']*\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?"
    suffix = "[uUlLfFzZ]{0,4}"
    skip = re.compile(
        r"//[^\n]*|/\*[\s\S]*?\*/|/\*|^[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*|(?:(?<!\w)(?:u8|[uUL]))?" + _quoted('"') + r"|(?:(?<!\w)[uUL])?'[^'\\\n]*(?:\\.[^'\\\n]*)*'|[\"'`$@]|\\\n|" + _CONTROL, re.M)
    operators = {
        **_classes(op="/ % << >> < > <= >= == != ^ | && ||", **{"+-": "+ -", "++": "++ --", "op=": "+= -= *= /= %= &= |= ^= <<= >>="}),
        **{t: t for t in ("->", "...", "=", "*", "&", "!", "~")},
    }
    _directive = re.compile(r"^[ \t]*#[ \t]*(ifdef|ifndef|if|elif\w*|else|endif)\b", re.M)

    def literal(self, text, m, keep):
        g = m.group()
        if g.startswith("//"):
            return "", m.end()
        if g == "/*":
            return BAD, len(text)
        if g.startswith("/*"):
            return ("\n" if "\n" in g else " "), m.end()
        if g.lstrip(" \t").startswith("#"):
            d = self._directive.match(g)
            if d and (d.group(1).startswith("el")):
                return self.other_branch(text, m.end())
            return "\n" * g.count("\n"), m.end()
        if g == "\\\n":
            return " ", m.end()
        return ('"' if len(g) > 1 and g != "''" else BAD), m.end()

    def other_branch(self, text, at):
        """Leaves out what follows an #else or #elif up to its #endif: one branch of a condition is parsed."""
        depth = 0
        for d in self._directive.finditer(text, at):
            word = d.group(1)
            if word.startswith("if"):
                depth += 1
            elif word == "endif":
                if not depth:
                    return "\n" * text.count("\n", at, d.start()), d.start()
                depth -= 1
        return BAD, len(text)

    def first_error(self, text):
        open_, marks = 0, 0
        for d in self._directive.finditer(re.sub(r"/\*[\s\S]*?\*/", lambda m: "\n" * m.group().count("\n"), text.replace("\r\n", "\n").replace("\r", "\n"))):
            word = d.group(1)
            open_ += (word.startswith("if")) - (word == "endif")
            marks = min(marks, open_)
        if marks < 0 or open_ > 0:
            found = super().first_error(text)
            return found if found is not None else text.count("\n") + 1
        return super().first_error(text)


KINDS = {"json": Json, "javascript": JavaScript, "typescript": TypeScript, "python": Python, "go": Go, "rust": Rust, "c": C}
_tables: dict[str, dict] = {}
_languages: dict[str, Language] = {}


def all_tables() -> dict[str, dict]:
    """Parse tables of every language, built once in a process."""
    for name, kind in KINDS.items():
        if name not in _tables:
            _tables[name] = build_tables(Grammar(kind.grammar, kind.start))
    return _tables


def first_error(text: str, language: str, tables: dict[str, dict] | None = None) -> int | None:
    """One-based line of the first error of a text in a language; None where it is valid."""
    found = _languages.get(language)
    if found is None:
        found = _languages[language] = KINDS[language]((tables or all_tables())[language])
    return found.first_error(text)


_CHECKED = StructType([
    StructField("file_id", LongType()), StructField("repo", StringType()), StructField("language", StringType()), StructField("error_line", IntegerType()),
])


def checked(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, error_line): each file of a known language, with the line of its first error or null.

    files: file_id, repo, path, content. The language is that of the extension in path; files of other extensions and null
    contents are left out. A text of white space only is valid, but as JSON. A file delivered again comes again.
    """
    spark = files.sparkSession
    tables = spark.sparkContext.broadcast(all_tables())
    name = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(F.trim("path"))]
    rows = files.filter("file_id is not null and content is not null").select("file_id", "repo", name.alias("language"), "content").filter("language is not null")

    def make():
        built = tables.value

        def kernel(file_id, repo, language, content):
            yield file_id, repo, language, first_error(content, language, built)

        return kernel

    return map_rows(rows, make, _CHECKED)


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate): share of invalid files; a file counts once, as invalid if any delivery is."""
    once = checked(files).groupBy("file_id").agg(
        F.min("repo").alias("repo"), F.min("language").alias("language"), F.max(F.col("error_line").isNotNull().cast("int")).alias("bad"))
    return once.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))

"""Secret scans by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_of

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Weights of the parts of a target name; a literal under such a name is likely a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "bearer": 0.8, "auth": 0.5, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "pass": 0.8, "signing": 0.4, "encryption": 0.4}
#: Last parts of names that say something about a secret but don't hold it.
ABOUT = frozenset("path file dir url uri name id type length size count ttl expiry hint policy format header field label prefix suffix regex pattern algorithm host port user username email version class".split())
#: Calls that read a name: their first argument is that name, not a literal.
READERS = frozenset("getenv get env environ getproperty setdefault fetch lookup".split())
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|-+|none|null|true|false|changeme|example.*|your[-_ ].*|<.*>|\$.*|\{.*|%.*|todo|test|dummy|placeholder)\Z", re.DOTALL)
_WORDS = re.compile(r"[A-Za-z._:/$\-]+\Z")

_STRING = r'''(?<![\w\\])(?:[rRbBuUfF]{1,2})?(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)'''
_ASSIGNS = r"[ \t]*+(?:=>|:=|\+=|\?=|=(?![=~>])|:(?![:/=]))"
_PLAIN = r"""[^\s=:<>"'`$(){}\[\],;+#/*\\]"""
#: One token. A run of plain words is one token, up to the word that could be a name; a name or a
#: string takes the assignment operator behind it along. Loops are possessive, a run of words
#: begins only where none is, and no string opens behind a backslash or a letter: what fails
#: isn't tried again from inside, so that lexing is linear.
_TOKEN = re.compile(
    rf"""(?P<fill>(?<!{_PLAIN})(?:{_PLAIN}++[ \t]++(?={_PLAIN}))++)"""
    rf"""|(?P<str>{_STRING})(?P<sop>{_ASSIGNS})?"""
    rf"""|(?P<name>(?<![\w$])[A-Za-z_][\w.\-]*+)(?P<nop>["']?{_ASSIGNS})?"""
    r"""|(?P<ref>\$\{?[A-Za-z_][\w.]*+)(?P<else>:?[-=])?\}?"""
    r"""|(?P<tag></?[A-Za-z][\w.:\-]*+(?:\s++[\w.:\-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+\s*+/?>)"""
    r"""|(?P<note>(?<!\S)(?:\#|//)|/\*|\*/|<!--|-->)"""
    r"""|(?P<op>=(?![=~>]))"""
    r"""|(?P<nl>\\?\n[ \t]*+(?:-[ \t]++)?)"""
    r"""|(?P<mark>[()\[\]{},;])"""
    r"""|(?P<other>\d[\w.\-]*+|[=:<>/*+]++)""",
    re.DOTALL | re.ASCII,
)
_GAP = re.compile(r"""[ \t]*+(?:\\?\n[ \t]*+(?=["'`]))?""")
_BARE = re.compile(r"""[^\s"'`#;,(){}\[\]<>$]++""")
_JOINED = re.compile(r"""[ \t]*+(?:[+.\\][ \t]*+\n?[ \t]*+)?(?=["'`A-Za-z_])""")
_JOINED_INSIDE = re.compile(r"""\s*+(?:\+\s*+)?(?=["'`A-Za-z_])""")
_NAME = re.compile(r"[A-Za-z_][\w.]*+", re.ASCII)
_OPERATOR = re.compile(_ASSIGNS)
_ANNOTATED = re.compile(r"[ \t]*+=(?![=~>])")
_ATTRIBUTE = re.compile(r"""([\w.:\-]++)\s*+=\s*+(?:"([^"<]*+)"|'([^'<]*+)')""")
_SECTION = re.compile(r"\[([\w .:\-\"]++)\][ \t]*+(?=\n|\Z)")
_SCOPE = re.compile(r"(?:(?:async|export|public|private|static)[ \t]++)*+(?:def|class)\b")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_LOGIN = re.compile(r"(?<![\w+.\-])[A-Za-z][\w+.\-]*+://[^\s/:@\"']*+:([^\s/@\"']++)@")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, in code points, leftmost and non-overlapping per kind."""
    if not text:
        return []
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def name_parts(name: str) -> frozenset[str]:
    """The sensitive parts of a name in snake, kebab, dotted or camel case, plurals included."""
    parts = {p.lower() for p in _NAME_PART.findall(name)}
    return frozenset(q for p in parts for q in (p, p.removesuffix("s")) if q in SENSITIVE)


def sensitivity(name: str, around: frozenset[str] = frozenset()) -> float:
    """Score from 0 to 1 of a target name, from its parts and those of the names it is nested in (``around``).

    A name that ends by saying something about a secret, as secret_path does, counts a third.
    """
    total = min(1.0, sum(SENSITIVE[p] for p in name_parts(name) | around))
    last = _NAME_PART.findall(name) if total else None
    return total / 3 if last and last[-1].lower() in ABOUT else total


def entropy(literal: str) -> float:
    """Bits per character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


def randomness(literal: str) -> float:
    """0 to 1: how little a literal looks like a word, a path, a name in code or a placeholder."""
    if len(literal) < 8 or " " in literal or _PLACEHOLDER.match(literal):
        return 0.0
    if _WORDS.match(literal) and all(p.islower() or p.isupper() or p.istitle() for p in re.split(r"[._:/$\-]+", literal) if p):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy(literal) / 3.0) if kinds >= 2 else 0.0


def score(name: str, literal: str, around: frozenset[str] = frozenset()) -> float:
    """How much ``name = literal`` looks like a secret, 0 to 1: the name's sensitivity times the literal's randomness."""
    known = sensitivity(name, around)
    return known * randomness(literal) if known else 0.0


@dataclass
class Literal:
    """A literal's value and the places of its pieces, more than one where it is concatenated."""

    value: str
    spans: tuple[tuple[int, int], ...]


@dataclass
class Pair:
    """``name`` is given ``literal``; ``around``: sensitive parts of the names it is nested in."""

    name: str
    literal: Literal
    around: frozenset[str] = frozenset()


@dataclass
class _Frame:
    """An open bracket: ``(`` call or group, ``[`` list, ``s`` subscript or ``{`` mapping or block; the target
    outside of it, the sensitive parts around, the function called and the literals inside so far."""

    kind: str
    target: str | None
    around: frozenset[str]
    call: str = ""
    inside: list[Literal] = field(default_factory=list)


class Lexer:
    """Name-literal pairs of one text, by one pass over its tokens.

    Targets are names before ``=``, ``:``, ``:=``, ``=>`` and ``+=``, quoted names, subscripts
    (``config["pwd"] = ...``), XML elements and attributes, setters, and name and value entries.
    Values are strings of any quotes with escapes, concatenations, bare words of configuration
    files, defaults of shell references, and what stands in lists and calls; strings that hold
    assignments themselves are read too. A name that was given a literal carries it on: to
    other names, through calls and references. Such constants end with the braces or the
    indented definition they stand in; those in comments are no constants. Names of JSON, YAML
    and INI nest.
    """

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[Pair] = []
        self.known: dict[str, list[Literal]] = {}
        self.scopes: list[tuple[int, list[str]]] = [(-1, [])]  # a definition's indentation, or -2 for a brace; the names given there
        self.frames: list[_Frame] = []
        self.parents: list[tuple[int, frozenset[str]]] = []  # YAML: column and sensitive parts
        self.section: frozenset[str] = frozenset()
        self.target: str | None = None
        self.colon = self.comment = self.remark = self.nested = False
        self.block: tuple[int, str] | None = None
        self.entry: str | None = None  # the latest name of a name and value entry
        self.run_end = self.run_operator = self.judged = 0  # of the latest bare run: its end, its last operator; how far it was judged

    # -- what was found ----------------------------------------------------------------------------
    def around(self) -> frozenset[str]:
        if self.frames:
            return self.frames[-1].around
        return self.section | self.parents[-1][1] if self.parents else self.section

    def give(self, literal: Literal) -> None:
        """A literal stands where the current target's value does."""
        frame = self.frames[-1] if self.frames else None
        if frame and frame.kind == "s":
            frame.inside.append(literal)
        elif frame and frame.kind == "(" and frame.call and self.target is frame.target:
            frame.inside.append(literal)
            self.argument(frame, literal)
        elif self.target:
            self.add(self.target, literal)

    def add(self, name: str, literal: Literal) -> None:
        self.pairs.append(Pair(name, literal, self.around()))
        low = name.lower()
        if low in ("name", "key"):
            self.entry = literal.value
        elif low in ("value", "val", "default") and self.entry:
            self.pairs.append(Pair(self.entry, literal, self.around()))
            self.entry = None
        if not self.comment and not self.remark and (not self.frames or self.frames[-1].kind == "{"):
            self.known.setdefault(name, []).append(literal)
            self.scopes[-1][1].append(name)

    def argument(self, frame: _Frame, literal: Literal) -> None:
        """A literal inside a call goes to the call's target; setPassword(x) and put("password", x) are targets themselves."""
        parts, n = [p.lower() for p in _NAME_PART.findall(frame.call)], len(frame.inside)
        own = name_parts(frame.call)
        if n == 1 and own and (parts[0] in ("set", "with") or own >= set(parts)):
            self.pairs.append(Pair(frame.call, literal))
        if n == 2 and parts and parts[0] in ("set", "put", "add", "with") and not own:
            self.pairs.append(Pair(frame.inside[0].value, literal))
        if frame.target and not (n == 1 and frame.call.lower() in READERS):
            self.pairs.append(Pair(frame.target, literal, frame.around))

    def held(self, name: str) -> Literal | None:
        found = self.known.get(name)
        return found[-1] if found else None

    def leave(self) -> None:
        """The innermost scope ends, and with it its constants."""
        for name in self.scopes.pop()[1]:
            self.known[name].pop()

    # -- the pass ----------------------------------------------------------------------------------
    def run(self, lo: int = 0, hi: int | None = None) -> list[Pair]:
        text, token = self.text, _TOKEN.search
        hi = len(text) if hi is None else hi
        at = self.line(lo, lo, hi)
        while m := token(text, at, hi):
            at, kind = m.end(), m.lastgroup
            if kind == "fill" or kind == "other":
                continue
            if kind == "nop":
                at = self.assigned(m["name"], at, hi, m.start(), m["nop"].lstrip("\"' \t")[0] == ":")
            elif kind == "name":
                if self.target and (held := self.held(m["name"])):
                    self.give(held)
            elif kind == "sop":
                a, b = m.span("str")
                at = self.assigned(_inside(text, a, b)[0], at, hi, a, m["sop"].lstrip()[0] == ":")
            elif kind == "str":
                at = self.string(*m.span("str"), hi)
            elif kind in ("ref", "else"):
                default = _BARE.match(text, m.end("else"), hi) if kind == "else" and m["ref"].startswith("${") else None
                if default and self.target:
                    self.give(Literal(default[0], (default.span(),)))
                elif self.target and (held := self.held(m["ref"].lstrip("${"))):
                    self.give(held)
                at = default.end() if default else at
            elif kind == "nl":
                if not m[0].startswith("\\"):
                    at = self.line(m.start() + 1, at, hi)
            elif kind == "tag":
                at = self.element(m, hi)
            elif kind == "op":
                if self.target and self.colon:
                    at = self.value(at, hi)
            elif kind == "note":
                self.remark = m[0] in ("/*", "<!--") or (self.remark and m[0] not in ("*/", "-->"))
                self.comment = self.comment or m[0] in ("#", "//")
            else:
                at = self.bracket(m[0], m.start(), at, hi)
        return self.pairs

    def line(self, start: int, at: int, hi: int) -> int:
        """A new line begins at ``start`` with its first token at ``at``."""
        text = self.text
        self.comment = False
        if at < hi and text[at] == "\n":  # an empty line ends what prose has left open
            while self.frames and self.frames[-1].kind != "{":
                self.frames.pop()
            self.target = None
            return at
        while self.frames and self.frames[-1].kind == "(" and not self.frames[-1].call and (self.colon or not self.frames[-1].target):
            self.frames.pop()  # a parenthesis of prose
        if not self.frames or self.frames[-1].kind == "{":
            self.target, self.colon = None, False
        indent = at - start
        while self.scopes[-1][0] >= indent:
            self.leave()
        if self.block:
            if indent > self.block[0]:
                if m := _BARE.match(text, at, hi):
                    self.pairs.append(Pair(self.block[1], Literal(m[0], (m.span(),)), self.around()))
                return m.end() if m else at
            self.block = None
        while self.parents and self.parents[-1][0] >= indent:
            self.parents.pop()
        if not self.frames:
            if m := _SECTION.match(text, at, hi):
                self.section, self.parents = name_parts(m[1]), []
                return m.end()
            if _SCOPE.match(text, at, hi):
                self.scopes.append((indent, []))
        return at

    def assigned(self, name: str, at: int, hi: int, start: int, colon: bool) -> int:
        """``name``, which begins at ``start``, and an assignment operator were read; goes on with the value."""
        if self.frames and self.frames[-1].kind == "s":
            return at
        self.target, self.colon = name, colon
        text, at = self.text, _GAP.match(self.text, at, hi).end()
        if colon and (at >= hi or text[at] in "\n|>"):
            column = start - (text.rfind("\n", max(0, start - 256), start) + 1)
            if at < hi and text[at] != "\n":
                self.block = (column, name)
                return at + 1
            if not self.frames:
                self.parents.append((column, self.around() | name_parts(name)))
            return at
        return self.value(at, hi)

    def value(self, at: int, hi: int) -> int:
        """Takes a bare word at ``at`` as the target's value; what isn't one is left to the tokens."""
        text, name = self.text, self.target
        at = _GAP.match(text, at, hi).end()
        if at >= self.run_end:
            m = _BARE.match(text, at, hi)
            if not m:
                return at
            self.run_end = m.end()
            self.run_operator = max(text.rfind(":", at, m.end()), text.rfind("=", at, m.end()))
        end = self.run_end
        word = _NAME.match(text, at, end)
        whole = bool(word) and word.end() == end
        if whole:
            if text[end : end + 1] in ("(", "[", "{", '"', "'", "`"):
                return at  # a call, a subscript, the prefix of a string
            if (held := self.held(word[0])) is not None:
                self.give(held)
                return end
            if self.colon and (m := _ANNOTATED.match(text, end, hi)):
                return self.value(m.end(), hi)  # name: type = value
        if sensitivity(name, self.around()) > 0:
            if at >= self.judged:
                self.judged = end
                literal = text[at:end].rstrip(".")
                if randomness(literal) and not (whole and not any(c.isdigit() for c in literal)):
                    self.give(Literal(literal, ((at, at + len(literal)),)))
                    return end
        elif at > self.run_operator:
            self.give(Literal(text[at:end], ((at, end),)))
            return end
        return at

    def string(self, a: int, b: int, hi: int) -> int:
        """A string that is no name: a value, with what is concatenated to it, or text with pairs of its own."""
        text = self.text
        value, s, e = _inside(text, a, b)
        values, spans, at = [value], [(s, e)], b
        if self.target or self.frames:
            inside = bool(self.frames) and self.frames[-1].kind == "("
            while m := (_JOINED_INSIDE if inside else _JOINED).match(text, at, hi):
                n = _TOKEN.match(text, m.end(), hi)
                if n and n.lastgroup == "str":
                    value, s, e = _inside(text, *n.span("str"))
                    values.append(value)
                    spans.append((s, e))
                elif n and n.lastgroup == "name" and "+" in m[0] and (held := self.held(n["name"])):
                    values.append(held.value)
                    spans += held.spans
                else:
                    break
                at = n.end()
            self.give(Literal("".join(values), tuple(spans)))
        if not self.nested:
            for s, e in spans:
                if s >= a and e <= at and (text.find("=", s, e) >= 0 or text.find(":", s, e) >= 0):
                    sub = Lexer(text)
                    sub.nested = True
                    self.pairs += sub.run(s, e)
        return at

    def bracket(self, c: str, start: int, at: int, hi: int) -> int:
        text, before = self.text, self.text[start - 1 : start]
        if c in "([{":
            around, kind = self.around(), c
            if c == "[" and (before.isalnum() or before in tuple(")]_")):
                kind = "s"
            if c == "{":
                around = around | name_parts(self.target or "")
                self.scopes.append((-2, []))
            self.frames.append(_Frame(kind, self.target, around, _called(text, start) if c == "(" else ""))
            if c == "{":
                self.target = None
        elif c in ")]}":
            if self.frames and self.frames[-1].kind in {")": "(", "]": "[s", "}": "{"}[c]:
                frame = self.frames.pop()
                self.target = frame.target
                if c == "}":
                    while self.scopes[-1][0] >= 0:
                        self.leave()
                    self.leave()
                elif frame.kind == "s" and len(frame.inside) == 1 and (m := _OPERATOR.match(text, at, hi)):
                    return self.assigned(frame.inside[0].value, m.end(), hi, start, False)
        elif self.frames and self.frames[-1].kind in "([":
            self.target = self.frames[-1].target
        else:
            self.target = None
        return at

    def element(self, m: re.Match, hi: int) -> int:
        """An XML tag: its attributes are pairs, and so is an element with its text."""
        text, (a, b) = self.text, m.span()
        if text[a + 1] == "/":
            return b
        name = re.match(r"[\w.:\-]+", text[a + 1 : b])[0]
        attributes = {}
        for x in _ATTRIBUTE.finditer(text, a + 1 + len(name), b):
            i = 2 if x[2] is not None else 3
            attributes[x[1].lower()] = literal = Literal(x[i], (x.span(i),))
            self.pairs.append(Pair(x[1], literal))
        named = attributes.get("name") or attributes.get("key")
        if named and "value" in attributes:
            self.pairs.append(Pair(named.value, attributes["value"]))
        inner = _BARE.match(text, _GAP.match(text, b, hi).end(), hi) if text[b - 2] != "/" else None
        if inner and text.startswith("</", inner.end(), hi):
            self.pairs.append(Pair(named.value if named else name, Literal(inner[0], (inner.span(),))))
            return inner.end()
        return b


def _inside(text: str, a: int, b: int) -> tuple[str, int, int]:
    """Value, start and end of what is inside the quotes of the string token from ``a`` to ``b``."""
    while text[a] not in "\"'`":
        a += 1
    n = 3 if b - a >= 6 and text[a] != "`" and text[a : a + 3] == 3 * text[a] else 1
    raw = text[a + n : b - n]
    return (_ESCAPE.sub(r"\1", raw) if "\\" in raw else raw), a + n, b - n


def _called(text: str, end: int) -> str:
    """The last part of the dotted name that ends at ``end``; names of calls over 64 characters are no setters."""
    start = end
    while start and end - start < 64 and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return text[start:end]


def pairs(text: str) -> list[Pair]:
    """The name-literal pairs of a text, see ``Lexer``; the passwords of URLs are pairs too."""
    found = Lexer(text).run() if any(c in text for c in "=:<(") else []
    if "://" in text:
        found = found + [Pair("password", Literal(m[1], (m.span(1),))) for m in _LOGIN.finditer(text)]
    return found


def scan(text: str | None, threshold: float = 0.8) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text: to the base come the literals that score ``threshold`` or more.

    A literal that lies inside a base span isn't repeated; a concatenated one gives a span for
    each of its pieces. Null and empty texts have none. A text with neither a URL nor any part of a
    sensitive name can have no such pair and isn't lexed.
    """
    base = base_spans(text)
    more: set[tuple[int, int, str]] = set()
    low = text.lower() if text else ""
    if "://" in low or any(part in low for part in SENSITIVE):
        starts = [s for s, _, _ in base]
        reach = list(accumulate((e for _, e, _ in base), max))
        judged: set[tuple] = set()
        for p in pairs(text):
            known = (sensitivity(p.name, p.around), p.literal.spans)
            if known[0] < threshold or known in judged:
                continue
            judged.add(known)
            if known[0] * randomness(p.literal.value) >= threshold:
                for a, b in p.literal.spans:
                    i = bisect_right(starts, a)
                    if b > a and not (i and reach[i - 1] >= b):
                        more.add((a, b, "literal"))
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: key, base (array of spans) and spans (array of spans).

    A span is a struct of start, end (code points, end exclusive) and kind. Null, empty and
    very long texts are scanned whole; repeated rows give repeated rows; an empty table gives
    none; other columns are ignored. A single pass without a shuffle.
    """
    span = "array<struct<start:long,end:long,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py(), threshold) for t in b.column("text")]
            lists = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("key"), *lists], ["key", "base", "spans"])

    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, base {span}, spans {span}").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mask: str = "[SECRET]", threshold: float = 0.8) -> DataFrame:
    """``docs``, every row and column, with the secrets in ``text`` replaced by ``mask``.

    Overlapping spans become one mask. ``n_chars``, where there is such a column, is the new
    length of the texts that changed. Null texts stay null, repeated rows stay, an empty table
    gives none, and other columns are carried along whatever their names.
    """
    schema = docs.schema
    where, count = place_of(docs, text), place_of(docs, n_chars)
    if where is None:
        raise ValueError(f"no column {text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(where).to_pylist()
            new = [mask_spans(t, scan(t, threshold)[1], mask) for t in old]
            columns = list(b.columns)
            columns[where] = pa.array(new, b.schema.types[where])
            if count is not None:
                columns[count] = pa.array([n if a == t else len(t) for n, a, t in zip(b.column(count).to_pylist(), old, new)], b.schema.types[count])
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, schema)


def mask_spans(text: str | None, spans: list[tuple[int, int, str]], mask: str) -> str | None:
    if not spans:
        return text
    out, at, over = [], 0, -1
    for a, b, _ in spans:
        if a >= over:
            out += [text[max(at, 0) : a], mask]
        over = at = max(over, b)
    return "".join([*out, text[at:]])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The spans of ``find_secrets`` as counts, a SHA-256 of the base spans and one string of all."""
    found = find_secrets(docs, key, text, threshold)
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(key, *map(count, KINDS[:3]), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def base_digest(text: str | None) -> str:
    """What ``digest`` gives as base_sha256, for one text."""
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()

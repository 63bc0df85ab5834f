"""Definitions and references of one source text.

A language is a reader of tokens: it says at which tokens definitions begin and
how far they go, and which tokens call or import a name. One walk in source
order keeps the stack of open definitions, so every reference knows the
symbol it is in. Broken text gives whatever can be read of it.

Node boundaries follow the usual grammars; in exotic syntax positions can
differ by a modifier or a trailing sign.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from .languages import LANGUAGES
from .lexing import Source, tokens

SIGNATURE_MOST = 240


class Symbol(NamedTuple):
    name: str
    kind: str
    container: str | None
    exported: bool
    signature: str | None
    start_row: int
    start_col: int
    end_row: int
    end_col: int
    start_byte: int
    end_byte: int


class Ref(NamedTuple):
    from_symbol: str | None
    name: str
    kind: str
    start_row: int
    start_col: int


class Parsed(NamedTuple):
    lang: str
    symbols: list[Symbol]
    refs: list[Ref]


class Def(NamedTuple):
    """A definition over tokens first..last; body is the token its body begins at. ``start``/``end`` override the offsets."""

    kind: str
    name: str
    first: int
    last: int
    body: int | None = None
    exported: bool = False


def signature_of(raw: str) -> str | None:
    """On one line; over SIGNATURE_MOST UTF-16 units it is cut, with an ellipsis."""
    text = " ".join(raw.split())
    if not text:
        return None
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) <= 2 * SIGNATURE_MOST:
        return text
    return units[: 2 * (SIGNATURE_MOST - 1)].decode("utf-16-le", "ignore") + "…"


def unquote(text: str) -> str:
    t = text.strip()
    if len(t) >= 2 and (t[0] == t[-1] and t[0] in "\"'`" or t[0] == "<" and t[-1] == ">"):
        return t[1:-1]
    return t


class Reader:
    """What the languages share. Subclasses set the tables and override ``define`` and ``imports``."""

    family = "c"
    ident = r"[A-Za-z_$\u0080-\U0010FFFF][\w$]*"
    newlines = False
    nested_methods = False
    #: Words before ( that call nothing.
    keywords: frozenset = frozenset("if for while switch catch return sizeof do else case throw function with typeof await yield in of new delete void instanceof and or not assert".split())
    members: tuple = (".",)
    member_calls = True
    scoped: tuple = ()  # signs of path-qualified callees: the last name is called
    bare_calls = True
    calls = True

    def __init__(self, text: str):
        self.s = Source(text, tokens(text, self.family, self.ident, self.newlines))
        self.scopes: list[Def] = []  # open definitions
        self.skip_to = -1  # tokens up to here give no calls
        self.names: set[int] = set()  # tokens that name a definition

    # -- what languages say
    def define(self, i: int) -> Def | None:
        return None

    def imports(self, i: int) -> list[str]:
        return []

    # -- the walk
    def read(self, lang: str) -> Parsed:
        s, symbols, refs = self.s, [], []
        for i in range(len(s.toks)):
            while self.scopes and self.scopes[-1].last < i:
                self.scopes.pop()
            if d := self.define(i):
                container = self.scopes[-1] if self.scopes else None
                kind = "method" if d.kind == "function" and self.nested_methods and container and container.kind == "class" else d.kind
                d = d._replace(kind=kind)
                start, end = s.toks[d.first].start, s.toks[min(d.last, len(s.toks) - 1)].end
                raw = s.text[start : s.toks[d.body].start if d.body is not None else end]
                symbols.append(Symbol(d.name, kind, container.name if container else None, d.exported, signature_of(raw), *s.place(start), *s.place(end), s.units(start), s.units(end)))
                self.scopes.append(d)
                last_part = d.name.lstrip("#~")
                self.names.add(next((j for j in range(i, d.last + 1) if s.toks[j].text == last_part), i))
            here = self.scopes[-1].name if self.scopes else None
            if self.calls and i > self.skip_to and i not in self.names and (c := self.call(i)):
                name, kind, first = c
                refs.append(Ref(here, name, kind, *s.place(s.toks[first].start)))
            for name in self.imports(i):
                if unquote(name):
                    refs.append(Ref(here, unquote(name), "import", *s.place(s.toks[i].start)))
        return Parsed(lang, symbols, refs)

    # -- calls
    def call(self, i: int) -> tuple[str, str, int] | None:
        """(name, kind, first token) if token i is a called name."""
        s = self.s
        if s.kind(i) != "id" or not self.opens_arguments(i):
            return None
        before = s.at(i - 1)
        if before in self.members:
            if not self.member_calls:
                return None
            first = self.chain(i)
            return None if s.at(first - 1) == "new" else (s.at(i), "method", first)
        if before in self.scoped:
            return (s.at(i), "call", self.chain(i))
        if before in ("::", "->", "\\") or not self.bare_calls or s.at(i) in self.keywords or before in self.no_call_after:
            return None
        return (s.at(i), "call", i)

    no_call_after: frozenset = frozenset("new function def fn func fun class interface struct enum trait".split())

    def opens_arguments(self, i: int) -> bool:
        return self.s.at(i + 1) == "("

    def chain(self, i: int) -> int:
        """The first token of the expression a.b(c)[d].name that ends at token i."""
        s = self.s
        while s.at(i - 1) in (*self.members, *self.scoped, "::"):
            j = i - 2
            while s.at(j) in (")", "]") and j in s.open:
                j = s.open[j] - 1
            if j == i - 2 and s.at(j) in ("!", "?") and s.kind(j - 1) in ("id",):
                j -= 1
            if s.kind(j) in ("id", "str", "num"):
                i = j
                while s.kind(i) == "str" and s.kind(i - 1) == "str":
                    i -= 1
            elif j + 1 < i - 1:
                i = j + 1
            else:
                return i
        return i

    # -- helpers for definitions
    def modified(self, i: int, modifiers: frozenset) -> int:
        """The first of the modifiers before token i."""
        s = self.s
        while True:
            if s.at(i - 1) in modifiers:
                i -= 1
            elif s.at(i - 1) == "]" and i - 1 in s.open and "[" in modifiers and s.at(s.open[i - 1] - 1) in (";", "{", "}", "]", ""):
                i = s.open[i - 1]
            elif s.at(i - 1) == ")" and i - 1 in s.open and s.at(s.open[i - 1] - 2) == "@":
                i = s.open[i - 1] - 2
            elif s.kind(i - 1) == "id" and s.at(i - 2) == "@":
                i -= 2
            else:
                return i

    def body_after(self, i: int, stop: tuple = (";",)) -> tuple[int | None, int]:
        """From token i on: (the brace that begins the body, last token), or (None, the stop)."""
        s, n = self.s, len(self.s.toks)
        while i < n:
            t = s.at(i)
            if t == "{":
                return i, s.close[i]
            if t in stop:
                return None, i
            if t in ("}", ")"):
                return None, i - 1
            i = s.close[i] + 1 if i in s.close else i + 1
        return None, n - 1

    def in_body_of(self, i: int, kinds: tuple = ("class", "interface", "enum")) -> Def | None:
        """The innermost definition if token i lies directly in its body."""
        if not self.scopes:
            return None
        d = self.scopes[-1]
        return d if d.kind in kinds and d.body is not None and self.s.parent[i] == d.body else None


class JavaScript(Reader):
    family = "js"
    members = (".", "?.")
    typed = False
    field_functions = False
    _MODS = frozenset("public private protected static abstract override readonly async get set declare accessor export default".split())
    keywords = Reader.keywords - {"of"} 

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if s.kind(i) not in ("id", "op", "str"):
            return None
        before = s.at(i - 1)
        member = before in (".", "?.")
        statement = before in ("", ";", "{", "}", ")", "export", "default", "async", "declare", "abstract", "const") or s.kind(i - 1) in ("id", "str", "num", "op") and i > 0 and not s.same_line(i - 1, i) and before not in ("=", "(", ",", ":", "?", "=>", "return", "&&", "||", "[", "new")
        if t == "function" and statement and not member:
            j = i + 1 + (s.at(i + 1) == "*")
            if s.kind(j) != "id":
                return None
            first = i - 1 if before == "async" else i
            body, last = self.function_end(s.angle(j + 1))
            return Def("function", s.at(j), first, last, body, self.is_exported(first))
        if t == "class" and statement and not member and s.kind(i + 1) == "id" and s.at(i + 1) not in ("extends", "implements"):
            first = i - 1 if before == "abstract" else i
            body, last = self.body_after(i + 2)
            return Def("class", s.at(i + 1), first, last, body, self.is_exported(first))
        if self.typed and s.kind(i + 1) == "id" and not member and before != "import" and statement:
            if t == "interface":
                body, last = self.body_after(i + 2)
                return Def("interface", s.at(i + 1), i, last, body, self.is_exported(i)) if body else None
            if t == "enum":
                first = i - 1 if before == "const" else i
                body, last = self.body_after(i + 2)
                return Def("enum", s.at(i + 1), first, last, body, self.is_exported(first))
            if t == "type":
                j = s.angle(i + 2)
                if s.at(j) == "=":
                    return Def("type", s.at(i + 1), i, self.value_end(j + 1), None, self.is_exported(i))
        return self.method(i) or self.binding(i)

    def is_exported(self, first: int) -> bool:
        return self.s.at(first - 1) == "export" or self.s.at(first - 1) in ("default", "declare") and self.s.at(first - 2) == "export"

    def function_end(self, i: int) -> tuple[int | None, int]:
        """Body and last token of a function whose parameters begin at token i."""
        s = self.s
        if s.at(i) != "(":
            return self.body_after(i)
        j = s.close[i] + 1
        if s.at(j) == ":":
            j += 1
            while s.at(j) == "{" or s.at(j) in ("|", "&") or s.at(j - 1) in (":", "|", "&", "=>") and s.at(j) in ("{", "["):
                if s.at(j) == "{" and s.at(j - 1) not in (":", "|", "&", "=>"):
                    break
                j = s.close[j] + 1 if j in s.close else j + 1
        start = j
        while j < len(s.toks):
            t = s.at(j)
            if t == "{":
                if s.at(j - 1) in ("|", "&", "=>", "<", ",") and j > start:
                    j = s.close[j] + 1
                    continue
                return j, s.close[j]
            if t == ";":
                return None, j
            if t in ("}", ")", ",") or j > start and not s.same_line(j - 1, j) and s.at(j - 1) not in ("|", "&", "=>", ":", "<", ","):
                return None, j - 1
            j = s.close[j] + 1 if j in s.close else j + 1
        return None, len(s.toks) - 1

    def method(self, i: int) -> Def | None:
        s = self.s
        if s.kind(i) not in ("id", "str") or s.at(i) in self.keywords or s.at(i) == "function" or s.at(s.parent[i]) not in ("{",):
            return None
        j = i + 1 + (s.at(i + 1) == "?")
        j = s.angle(j)
        if s.at(j) != "(":
            return None
        first = i
        if s.at(first - 1) in ("*", "#"):
            first -= 1
        first = self.modified(first, self._MODS)
        before = s.at(first - 1)
        inside = self.in_body_of(i, ("class", "interface", "type"))
        fresh = before in ("{", "}", ";", ",") or inside is not None and first > 0 and not s.same_line(first - 1, first)
        if not fresh:
            return None
        body, last = self.function_end(j)
        name = ("#" if s.at(i - 1) == "#" else "") + s.at(i)
        if body is not None:
            return Def("method", name, first, last, body)
        if inside is not None and self.typed:
            return Def("method", name, first, last - (s.at(last) == ";"), None)
        return None

    def binding(self, i: int) -> Def | None:
        """name = (...) => ... in a declaration, or in a class where fields can hold functions."""
        s = self.s
        if s.kind(i) != "id" or s.at(i) in self.keywords:
            return None
        field = False
        if s.at(i - 1) in ("const", "let", "var"):
            first = i
        elif self.field_functions and self.in_body_of(i, ("class",)) is not None:
            first, field = self.modified(i, self._MODS), True
            if s.at(first - 1) not in ("{", "}", ";", ")") and s.same_line(first - 1, first):
                return None
        else:
            return None
        j = i + 1
        if s.at(j) in ("?", "!"):
            j += 1
        if s.at(j) == ":":
            while j < len(s.toks) and s.at(j) not in ("=", ";"):
                j = s.close[j] + 1 if j in s.close else j + 1
        if s.at(j) != "=" or not self.is_function(j + 1):
            return None
        exported = not field and self.s.at(i - 2) in ("export",)
        return Def("function", s.at(i), first, self.value_end(j + 1), None, exported)

    def is_function(self, j: int) -> bool:
        s = self.s
        if s.at(j) == "async":
            j += 1
        if s.at(j) == "function":
            return True
        if s.kind(j) == "id" and s.at(j + 1) == "=>":
            return True
        j = s.angle(j)
        if s.at(j) != "(":
            return False
        k = s.close[j] + 1
        if s.at(k) == ":":
            while k < len(s.toks) and s.at(k) not in ("=>", ";", "=", "}"):
                k = s.close[k] + 1 if k in s.close else k + 1
        return s.at(k) == "=>"

    def value_end(self, j: int) -> int:
        """The last token of the expression or type that begins at token j."""
        s, start = self.s, j
        going = ("=", "|", "&", "=>", "+", "-", "*", "&&", "||", "?", ":", ",", "(", ".", "?.", "<")
        while j < len(s.toks):
            if s.at(j) in (";", ",", ")", "]", "}"):
                return j - 1
            if j > start and not s.same_line(j - 1, j) and s.at(j - 1) not in going and s.at(j) not in going:
                return j - 1
            j = s.close[j] + 1 if j in s.close else j + 1
        return len(s.toks) - 1

    def opens_arguments(self, i: int) -> bool:
        s = self.s
        j = i + 1
        if s.at(j) == "?." and s.at(j + 1) == "(":
            return True
        if self.typed and s.at(j) == "<":
            j = s.angle(j)
        return s.at(j) == "("

    def call(self, i: int):
        s = self.s
        if s.at(i) == "import" and s.at(i + 1) == "(" and s.at(i - 1) not in self.members:
            return "import", "call", i
        return super().call(i)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "import" or s.at(i + 1) in ("(", ".") or s.at(i - 1) in self.members:
            return []
        if s.kind(i + 1) == "str":
            return [s.at(i + 1)]
        for j in range(i + 1, min(len(s.toks), i + 4000)):
            if s.at(j) == "from" and s.kind(j + 1) == "str":
                return [s.at(j + 1)]
            if s.at(j) in (";", "=", "("):
                break
        return []


class TypeScript(JavaScript):
    typed = True
    field_functions = True


class Python(Reader):
    family = "python"
    newlines = True
    keywords = frozenset("if elif else while for in is not and or return yield lambda await assert del with as except raise import from def class async".split())

    def __init__(self, text: str):
        super().__init__(text)
        s = self.s
        keep = [t for i, t in enumerate(s.toks) if not (t.kind == "nl" and s.parent[i] >= 0) and t.text != "\\"]
        # logical lines: a newline inside brackets or after a backslash does not end one
        joined = []
        for t in keep:
            if t.kind == "nl" and s.text[: t.start].endswith("\\"):
                continue
            joined.append(t)
        self.ends: list[int] = []
        toks = []
        self.fresh: set[int] = set()
        new = True
        for t in joined:
            if t.kind == "nl":
                new = True
                continue
            if new:
                self.fresh.add(len(toks))
                new = False
            toks.append(t)
        self.s = Source(text, toks)
        self._line_starts = sorted(self.fresh)

    def column(self, i: int) -> int:
        start = self.s.lines[self.s.place(self.s.toks[i].start)[0]]
        return len(self.s.text[start : self.s.toks[i].start].expandtabs(8))

    def define(self, i: int) -> Def | None:
        s = self.s
        if s.at(i) not in ("def", "class") or s.kind(i + 1) != "id":
            return None
        first = i - 1 if s.at(i - 1) == "async" and i - 1 in self.fresh else i
        if first not in self.fresh and s.at(first - 1) not in (":", ";"):
            return None
        j = i + 2
        while j < len(s.toks) and s.at(j) != ":" and j not in self.fresh:
            j = s.close[j] + 1 if j in s.close else j + 1
        indent = self.column(first)
        last = len(s.toks) - 1
        for k in self._line_starts[bisect_right(self._line_starts, i) :]:
            if self.column(k) <= indent:
                last = k - 1
                break
        body = j + 1 if s.at(j) == ":" and j + 1 <= last else None
        return Def("function" if s.at(i) == "def" else "class", s.at(i + 1), first, max(last, min(j, len(s.toks) - 1)), body)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if i not in self.fresh and s.at(i - 1) not in (":", ";"):
            return []

        def dotted(j: int) -> tuple[str, int]:
            out = ""
            while j not in self.fresh and (s.kind(j) == "id" and s.at(j) not in ("import", "as") or s.at(j) in (".", "...")):
                out += s.at(j)
                j += 1
            return out, j

        if s.at(i) == "from":
            return [dotted(i + 1)[0]]
        if s.at(i) != "import":
            return []
        out, j = [], i + 1
        while True:
            name, j = dotted(j)
            out.append(name)
            if s.at(j) == "as":
                j += 2
            if s.at(j) != "," or j in self.fresh:
                return out
            j += 1


class Go(Reader):
    family = "go"
    keywords = frozenset("if for switch func return go defer select case range var const type import map chan interface struct".split())

    def define(self, i: int) -> Def | None:
        s = self.s
        if s.at(i) == "func" and (s.at(i - 1) in ("", ")", "}", '"') or s.kind(i - 1) in ("id", "str", "num") and not s.same_line(i - 1, i)):
            j, kind = i + 1, "function"
            if s.at(j) == "(":
                j, kind = s.close[j] + 1, "method"
            if s.kind(j) != "id":
                return None
            k = j + 1
            if s.at(k) == "[":
                k = s.close[k] + 1
            k = s.close.get(k, k) + 1
            while k < len(s.toks) and s.at(k) != "{" and s.same_line(k - 1, k):
                k = s.close[k] + 1 if k in s.close else k + 1
                while s.at(k) == "{" and s.at(k - 1) in ("interface", "struct"):
                    k = s.close[k] + 1
            body = k if s.at(k) == "{" else None
            return Def(kind, s.at(j), i, s.close[k] if body else k - 1, body)
        if s.kind(i) == "id" and (s.at(i - 1) == "type" or s.at(s.parent[i]) == "(" and s.at(s.parent[i] - 1) == "type" and (i - 1 == s.parent[i] or not s.same_line(i - 1, i))):
            j = i + 1
            if s.at(j) == "[" and s.kind(j + 1) == "id" and s.at(s.close[j] + 1) not in ("",) and s.at(j + 2) != "]":
                j = s.close[j] + 1
            if s.at(j) == "=":
                return None
            return Def("class", s.at(i), i, s.line_end(i))
        return None

    def call(self, i: int) -> tuple[str, str, int] | None:
        s = self.s
        in_interface = s.at(s.parent[i]) == "{" and s.at(s.parent[i] - 1) == "interface"
        return None if in_interface else super().call(i)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.kind(i) != "str":
            return []
        if s.at(i - 1) == "import" or s.at(i - 2) == "import" and s.kind(i - 1) in ("id", "op") and s.at(i - 1) != "(":
            return [s.at(i)]
        p = s.parent[i]
        return [s.at(i)] if p >= 0 and s.at(p) == "(" and s.at(p - 1) == "import" else []


class Rust(Reader):
    family = "rust"
    scoped = ("::",)
    keywords = Reader.keywords | frozenset("match loop fn let mut ref move impl where unsafe pub crate".split())
    _MODS = frozenset("pub async unsafe const extern default".split())

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if s.kind(i) != "id" or s.kind(i + 1) != "id":
            return None
        first = self.modified(i, self._MODS)
        if s.at(first - 1) == ")" and s.at(s.open.get(first - 1, 0) - 1) == "pub":
            first = s.open[first - 1] - 1
        if t == "fn":
            body, last = self.body_after(s.angle(i + 2))
            return Def("function", s.at(i + 1), first, last, body) if body is not None else None
        if t in ("struct", "union", "enum", "trait"):
            if t == "union" and s.at(s.angle(i + 2)) != "{":
                return None
            j = s.angle(i + 2)
            body, last = self.body_after(j)
            if s.at(j) == "(":
                body = j
            return Def({"struct": "class", "union": "class", "enum": "enum", "trait": "interface"}[t], s.at(i + 1), first, last, body)
        if t == "type" and s.at(s.angle(i + 2)) == "=":
            return Def("type", s.at(i + 1), first, self.body_after(i)[1])
        return None

    def call(self, i: int):
        s = self.s
        if s.kind(i) == "id" and s.at(i + 1) == "!" and s.at(i + 2) in Source.PAIRS:
            self.skip_to = max(self.skip_to, s.close[i + 2])  # tokens of a macro are no expressions
            return None
        if self.in_body_of(i, ("enum",)) is not None:
            return None  # a variant
        found = super().call(i)
        if found:
            after = s.at(s.close[i + 1] + 1)
            if after in ("=>", "|", "if") or s.at(found[2] - 1) in ("let", "#"):
                return None
        return found

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "use" or s.kind(i + 1) not in ("id", "op") or s.at(i + 1) in ("<",):
            return []
        end = self.body_after_semicolon(i)
        return [s.text[s.toks[i + 1].start : s.toks[end - 1].end]] if end > i + 1 else []

    def body_after_semicolon(self, i: int) -> int:
        s = self.s
        while i < len(s.toks) and s.at(i) != ";":
            i += 1
        return i


class Java(Reader):
    family = "jvm"
    _TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}
    _MODS = frozenset("public private protected static abstract final native synchronized transient volatile strictfp default sealed".split())
    keywords = Reader.keywords | frozenset("super this synchronized try".split())
    #: signs that may stand before the body of a method
    arrow = False

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if s.kind(i) != "id":
            return None
        if t in self._TYPES and s.kind(i + 1) == "id" and s.at(i - 1) != "." and not (t == "record" and s.at(s.angle(i + 2)) not in ("(", "{", ";", ":")):
            first = self.modified(i, self._MODS)
            j = i + 2 if not (t == "record" and s.at(i + 1) in ("class", "struct")) else i + 3
            body, last = self.body_after(j)
            return Def(self._TYPES[t], s.at(j - 1), first, last, body) if body is not None or t == "record" else None
        return self.method(i)

    def method(self, i: int) -> Def | None:
        s = self.s
        owner = self.in_body_of(i)
        j = s.angle(i + 1) if self.arrow else i + 1
        if owner is None or s.at(j) != "(" or s.at(i) in self.keywords:
            return None
        before = s.at(i - 1)
        typed = s.kind(i - 1) == "id" and before not in ("new", "return", "else", "throw") or before in (">", "]", "?", "*")
        if typed and before in self._MODS and s.at(i) != owner.name:
            return None
        if not typed and s.at(i) != owner.name:
            return None
        if before in (".", "=", "@"):
            return None
        first = self.first_of_member(i)
        k = s.close[j] + 1
        body, last = None, None
        while k < len(s.toks):
            if s.at(k) == "{":
                body, last = k, s.close[k]
                break
            if s.at(k) == "=>" and self.arrow:
                body = k
                while k < len(s.toks) and s.at(k) != ";":
                    k = s.close[k] + 1 if k in s.close else k + 1
                last = min(k, len(s.toks) - 1)
                break
            if s.at(k) == ";":
                last = k
                break
            if s.at(k) in (",", "}", ")", "="):
                break
            k = s.close[k] + 1 if k in s.close else k + 1
        return Def("method", s.at(i), first, last, body) if last is not None else None

    def first_of_member(self, i: int) -> int:
        """Behind the ; or brace before a member."""
        s, j = self.s, i
        while j > 0 and s.at(j - 1) not in (";", "{", "}"):
            j = s.open[j - 1] if j - 1 in s.open and s.at(j - 1) != "}" else j - 1
        return j

    def call(self, i: int):
        if self.in_body_of(i) is not None and self.s.at(i - 1) in ("{", ",", "@"):
            return None  # an enum constant or an annotation
        if self.s.at(i - 1) == "@":
            return None
        return super().call(i)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "import":
            return []
        j = i + 1 + (s.at(i + 1) == "static")
        out = ""
        while s.kind(j) == "id" or s.at(j) == "." and s.kind(j + 1) == "id":
            out += s.at(j)
            j += 1
        return [out]


class CSharp(Java):
    family = "c"
    arrow = True
    members = (".", "?.")
    _TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "class", "struct": "class"}
    _MODS = frozenset("public private protected internal static abstract sealed virtual override async readonly partial extern unsafe new const [".split())
    keywords = Java.keywords | frozenset("using lock fixed base foreach when".split())

    def opens_arguments(self, i: int) -> bool:
        return self.s.at(i + 1) == "("

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "using" or s.kind(i + 1) != "id" or s.at(i - 1) not in ("", ";", "}", "{", "global"):
            return []
        j = i + 1 + (s.at(i + 1) == "static")
        out, names = [], ""
        while s.kind(j) == "id" or s.at(j) in (".", "="):
            if s.at(j) == "=":
                out.append(names)
                names = ""
            else:
                names += s.at(j)
            j += 1
        return [*out, names] if s.at(j) == ";" else []


class C(Reader):
    family = "c"
    members = (".", "->")
    _SPEC = {"struct": "class", "union": "class", "enum": "enum"}
    keywords = Reader.keywords | frozenset("defined alignof static_assert decltype noexcept __attribute__ int char float double long short unsigned signed bool auto constexpr".split())

    def __init__(self, text: str):
        # directives other than includes are no code
        super().__init__(re.sub(r"^[ \t]*#(?!\s*(?:include|import))(?:\\\n|[^\n])*", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.M))
        self.s.text = text

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if s.kind(i) not in ("id", "op"):
            return None
        if t in self._SPEC and s.at(i - 1) != "enum":
            j = i + 1
            if t == "enum" and s.at(j) in ("class", "struct") and "class" in self._SPEC:
                j += 1
            if s.kind(j) == "id" and s.at(i - 1) not in ("<", ",", "friend"):
                k = j + 1
                while s.at(k) == "final" or s.at(k) == ":" and "class" in self._SPEC:
                    k += 1
                    while k < len(s.toks) and s.at(k) not in ("{", ";", "}", ")"):
                        k += 1
                if s.at(k) == "{":
                    return Def(self._SPEC[t], s.at(j), i, s.close[k], k)
                return Def(self._SPEC[t], s.at(j), i, j)
        return self.function(i)

    def function(self, i: int) -> Def | None:
        s = self.s
        if s.kind(i) != "id" or s.at(i + 1) != "(" or s.at(i) in self.keywords or any(d.kind in ("function", "method") for d in self.scopes):
            return None
        before = s.at(i - 1)
        if before in (".", "->", "=", "(", ",", "return", "!", "?", "+", "-"):
            return None
        k = s.close[i + 1] + 1
        while k < len(s.toks):
            t = s.at(k)
            if t == "{":
                break
            if t in (";", "=", ",", "}", ")") or t == "(" and s.at(k - 1) not in ("noexcept", "__attribute__", "throw"):
                if t == "(" and self.initialisers(k):
                    k = s.close[k] + 1
                    continue
                return None
            k = s.close[k] + 1 if k in s.close else k + 1
        if s.at(k) != "{":
            return None
        if s.at(k - 1) == "}" or s.kind(k - 1) == "id" and s.at(k - 2) in (":", ",") and self.has_colon(s.close[i + 1] + 1, k):
            nxt = s.close[k] + 1
            while s.at(nxt) == "," or s.at(nxt) == "{":
                if s.at(nxt) == "{":
                    k = nxt
                    break
                nxt += 1
        name = s.at(i)
        first = i
        while first > 0 and s.at(first - 1) not in (";", "}", "{", ":"):
            if s.at(first - 1) == "#" or s.kind(first - 1) == "str":
                break
            first -= 1
            if first in s.open and s.at(first) != "}":
                first = s.open[first]
        while s.at(first) in (">",) or s.at(first) == "include":
            first += 1
        if before == "~":
            name = "~" + name
        return Def("function", name, min(first, i), s.close[k], k)

    def initialisers(self, k: int) -> bool:
        return self.s.kind(k - 1) == "id" and self.s.at(k - 2) in (":", ",")

    def has_colon(self, a: int, b: int) -> bool:
        return any(self.s.at(x) == ":" for x in range(a, b))

    def call(self, i: int):
        s = self.s
        inside = [d for d in self.scopes if d.kind in ("function", "method")]
        if inside and inside[-1].body is not None and i < inside[-1].body and s.at(i - 1) not in (".", "->"):
            return None
        before = s.at(i - 1)
        if s.at(i + 1) == "(" and s.kind(i - 1) == "id" and before not in ("return", "else", "do", "case", "throw", "co_await", "co_return", "co_yield", "goto", "in"):
            return None  # a declaration
        if not inside and before in ("*", "&", "~"):
            return None
        if before == "::":
            return None
        return super().call(i)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "#" or s.at(i + 1) not in ("include", "import"):
            return []
        line = s.text[s.toks[i].start :].split("\n", 1)[0]
        m = re.match(r"#\s*(?:include|import)\s*(<[^>]*>|\"[^\"]*\"|\w+)", line)
        return [m[1]] if m else []


class Cpp(C):
    _SPEC = {"struct": "class", "class": "class", "enum": "enum"}
    nested_methods = True


class ObjectiveC(C):
    family = "c"
    member_calls = False
    _SPEC: dict = {}

    def define(self, i: int) -> Def | None:
        s = self.s
        if s.at(i) == "@" and s.at(i + 1) in ("interface", "implementation") and s.kind(i + 2) == "id":
            last = next((j + 1 for j in range(i, len(s.toks) - 1) if s.at(j) == "@" and s.at(j + 1) == "end"), len(s.toks) - 1)
            return Def("class", s.at(i + 2), i, last)
        if s.at(i) in ("-", "+") and s.at(i + 1) == "(" and self.scopes and self.scopes[-1].kind == "class" and (i == 0 or not s.same_line(i - 1, i)):
            j = s.close[i + 1] + 1
            if s.kind(j) != "id":
                return None
            body, last = self.body_after(j)
            return Def("method", s.at(j), i, last, body)
        return None

    def call(self, i: int):
        s = self.s
        if s.kind(i - 1) == "id" and s.at(i - 1) not in ("return", "else", "do", "case"):
            return None
        return Reader.call(self, i)


class Php(Reader):
    family = "php"
    members = ("->", "?->", "::")
    ident = r"\$?[A-Za-z_\u0080-\U0010FFFF]\w*"
    keywords = Reader.keywords | frozenset("array list isset empty unset echo print exit die include require fn match elseif foreach use declare".split())
    _MODS = frozenset("public private protected static abstract final readonly".split())

    def __init__(self, text: str):
        at = text.find("<?")
        super().__init__(text if at < 0 else re.sub(r"[^\n]", " ", text[:at]) + "     "[: len(text[at : at + 5])] + text[at + 5 :] if text.startswith("<?php", max(at, 0)) else text)
        self.s.text = text

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        kinds = {"class": "class", "trait": "class", "interface": "interface", "enum": "enum"}
        if t in kinds and s.kind(i + 1) == "id" and s.at(i - 1) not in ("::", "->", "new") and s.at(i + 1) != "extends":
            first = self.modified(i, self._MODS)
            body, last = self.body_after(i + 2)
            return Def(kinds[t], s.at(i + 1), first, last, body) if body is not None else None
        if t == "function":
            j = i + 1 + (s.at(i + 1) == "&")
            if s.kind(j) != "id" or s.at(j + 1) != "(":
                return None
            body, last = self.body_after(s.close[j + 1] + 1)
            owner = self.in_body_of(i)
            first = self.modified(i, self._MODS) if owner else i
            return Def("method" if owner else "function", s.at(j), first, last, body) if owner or body is not None else None
        return None

    def call(self, i: int):
        if self.s.at(i).startswith("$"):
            return None
        return super().call(i)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "use" or s.at(i + 1) == "(" or self.in_body_of(i) is not None or any(d.kind != "class" for d in self.scopes):
            return []
        j, start, out = i + 1, i + 1, []
        if s.at(j) in ("function", "const"):
            start = j = j + 1
        while j < len(s.toks):
            if s.at(j) == "{":
                return []
            if s.at(j) in (",", ";"):
                if j > start:
                    out.append(s.text[s.toks[start].start : s.toks[j - 1].end])
                start = j + 1
                if s.at(j) == ";":
                    break
            j += 1
        return out


class Indented(Reader):
    """Definitions whose body is braces or an expression that goes on while lines are further in."""

    def expression_end(self, i: int, first: int) -> int:
        s = self.s
        col = s.place(s.toks[first].start)[1]
        j = i
        while j < len(s.toks):
            if j in s.close:
                j = s.close[j]
            if j + 1 >= len(s.toks) or s.at(j + 1) in ("}", ")", "]"):
                return j
            if not s.same_line(j, j + 1) and s.place(s.toks[j + 1].start)[1] <= col:
                return j
            if s.at(j + 1) == ";":
                return j
            j += 1
        return len(s.toks) - 1


class Scala(Indented):
    family = "jvm"
    _MODS = frozenset("private protected implicit override final sealed abstract lazy case inline".split())
    keywords = Reader.keywords | frozenset("match def val var type import extends with".split())

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        kinds = {"class": "class", "object": "class", "trait": "interface", "def": "method", "type": "type"}
        if t not in kinds or s.kind(i + 1) != "id" or s.at(i - 1) == ".":
            return None
        first = self.modified(i, self._MODS)
        if t == "type":
            return Def("type", s.at(i + 1), first, self.expression_end(i, first))
        j = i + 2
        if s.at(j) == "[":
            j = s.close[j] + 1
        while j < len(s.toks) and s.at(j) not in ("{", "=", "}", ")"):
            if j > i + 2 and not s.same_line(j - 1, j) and s.at(j) in ("def", "val", "var", "class", "object", "trait", "import", "private", "override", "case", "}"):
                break
            j = s.close[j] + 1 if j in s.close else j + 1
        if s.at(j) == "{":
            return Def(kinds[t], s.at(i + 1), first, s.close[j], j)
        if s.at(j) == "=" and t == "def":
            return Def("method", s.at(i + 1), first, s.close[j + 1] if s.at(j + 1) == "{" else self.expression_end(j + 1, first), j + 1)
        return Def(kinds[t], s.at(i + 1), first, max(i + 1, j - 1))

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "import":
            return []
        j, out = i + 1, ""
        while s.kind(j) == "id" and s.at(j) != "_" or s.at(j) == "." and s.kind(j + 1) == "id" and s.at(j + 1) != "_":
            if j > i + 1 and not s.same_line(j - 1, j):
                break
            out += s.at(j)
            j += 1
        return [out]

    def call(self, i: int):
        return None if self.s.at(i - 1) in ("def", "class", "object", "extends", "case") else super().call(i)


class Solidity(Reader):
    member_calls = False
    keywords = Reader.keywords | frozenset("mapping returns constructor receive fallback unchecked assembly modifier event error".split())
    _TYPES = {"contract": "class", "library": "class", "struct": "class", "interface": "interface", "enum": "enum"}

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if s.kind(i + 1) != "id":
            return None
        if t in self._TYPES:
            first = i - 1 if s.at(i - 1) == "abstract" else i
            body, last = self.body_after(i + 2)
            return Def(self._TYPES[t], s.at(i + 1), first, last, body) if body is not None else None
        if t in ("function", "modifier"):
            body, last = self.body_after(i + 2)
            return Def("method" if t == "function" else "function", s.at(i + 1), i, last, body)
        return None

    def call(self, i: int):
        s = self.s
        d = self.scopes[-1] if self.scopes else None
        if s.at(i - 1) in ("function", "modifier", "emit", "revert", "error", "event", "new") or d and d.body is not None and i < d.body:
            return None
        return super().call(i)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "import":
            return []
        for j in range(i + 1, min(i + 200, len(s.toks))):
            if s.kind(j) == "str":
                return [s.at(j)]
            if s.at(j) == ";":
                break
        return []


class Zig(Reader):
    family = "rust"
    member_calls = False
    keywords = Reader.keywords | frozenset("fn pub const var switch orelse catch try defer comptime".split())

    def define(self, i: int) -> Def | None:
        s = self.s
        if s.at(i) != "fn" or s.kind(i + 1) != "id":
            return None
        first = self.modified(i, frozenset("pub export inline extern".split()))
        body, last = self.body_after(i + 2)
        return Def("function", s.at(i + 1), first, last, body)

    def call(self, i: int):
        return None if self.s.at(i - 1) in ("@", "fn") else super().call(i)


class Kotlin(Indented):
    family = "jvm"
    calls = False
    nested_methods = True
    _MODS = frozenset("public private protected internal open abstract final override data sealed inline suspend operator infix enum annotation inner companion tailrec lateinit const".split())

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if t not in ("class", "interface", "object", "fun") or s.at(i - 1) in (".", "::"):
            return None
        first = self.modified(i, self._MODS)
        j = s.angle(i + 1)
        if s.kind(j) != "id":
            return None
        if t == "fun":
            k = s.angle(j + 1)
            while s.at(k) in (".", "?."):
                j, k = k + 1, s.angle(k + 2)
        else:
            k = s.angle(j + 1)
        name, kind = s.at(j), "function" if t == "fun" else "class"
        while k < len(s.toks) and s.at(k) not in ("{", "=", "}", ")", ";"):
            if not s.same_line(k - 1, k) and s.at(k) not in (":", ",", "where") and s.at(k - 1) not in (":", ","):
                return Def(kind, name, first, k - 1)
            k = s.close[k] + 1 if k in s.close else k + 1
        if s.at(k) == "{":
            return Def(kind, name, first, s.close[k], k)
        if s.at(k) == "=" and t == "fun":
            return Def(kind, name, first, self.expression_end(k + 1, first), k)
        return Def(kind, name, first, min(k, len(s.toks)) - 1)

    def imports(self, i: int) -> list[str]:
        s = self.s
        if s.at(i) != "import":
            return []
        j, out = i + 1, ""
        while s.kind(j) == "id" and s.at(j) != "as" or s.at(j) == "." and s.kind(j + 1) == "id":
            if j > i + 1 and not s.same_line(j - 1, j):
                break
            out += s.at(j)
            j += 1
        return [out]


class Ruby(Reader):
    family = "ruby"
    newlines = True
    ident = r"[A-Za-z_\u0080-\U0010FFFF]\w*[?!]?(?!=[^=~>])|[A-Za-z_\u0080-\U0010FFFF]\w*"
    members = (".", "&.")
    keywords = frozenset("if unless while until case when then else elsif end def class module begin rescue ensure do return yield and or not in self nil true false super defined? alias undef break next redo retry".split())
    _BLOCKS = frozenset("class module def begin case do for".split())
    _HEADS = frozenset("if unless while until".split())

    def __init__(self, text: str):
        super().__init__(text)
        s = self.s
        fresh = [i == 0 or s.kind(i - 1) == "nl" or s.at(i - 1) == ";" for i in range(len(s.toks))]
        self.fresh = {i for i, f in enumerate(fresh) if f}
        self.ends: dict[int, int] = {}
        stack: list[tuple[int, bool]] = []
        loop = False
        for i, t in enumerate(s.toks):
            if t.kind == "nl":
                loop = False
            if t.kind != "id" or s.at(i - 1) in (".", "&.", "::", ":") or s.at(i + 1) == ":" and s.at(i + 2) != ":":
                continue
            if t.text in self._BLOCKS and not (t.text == "do" and loop) and not (t.text == "class" and s.at(i - 1) == "def"):
                stack.append((i, False))
                loop = loop or t.text == "for"
            elif t.text in self._HEADS and (i in self.fresh or s.at(i - 1) in ("=", "(", "else", "then", "do", "{", "return", "&&", "||")):
                stack.append((i, False))
                loop = t.text in ("while", "until")
            elif t.text == "end" and stack:
                self.ends[stack.pop()[0]] = i
        for i, _ in stack:
            self.ends[i] = len(s.toks) - 1

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if i not in self.ends or t not in ("def", "class", "module"):
            return None
        j = i + 1
        if t == "def" and s.kind(j) == "id" and s.at(j + 1) == ".":
            j += 2
        elif t != "def":
            while s.at(j + 1) == "::":
                j += 2
            if s.kind(j) != "id":
                return None
        if s.kind(j) == "nl":
            return None
        name = s.at(j) if t == "def" else s.text[s.toks[i + 1].start : s.toks[j].end]
        body = j + 1
        if s.at(body) == "(":
            body = s.close[body] + 1
        while body < self.ends[i] and s.kind(body) != "nl" and s.at(body) != ";":
            body += 1
        while body < self.ends[i] and (s.kind(body) == "nl" or s.at(body) == ";"):
            body += 1
        return Def("method" if t == "def" else "class", name, i, self.ends[i], body if body < self.ends[i] else None)

    def call(self, i: int):
        s = self.s
        if s.kind(i) != "id" or s.at(i - 1) in ("def", "class", "module", "::", ":", "@", "$"):
            return None
        if s.at(i - 1) in self.members:
            d = self.scopes[-1] if self.scopes else None
            if d and s.at(i - 3) == "def":
                return None
            if s.at(i + 1) == "=" and s.at(i + 2) != "=":
                return None
            return s.at(i), "method", self.chain(i)
        if s.at(i) in self.keywords or s.at(i + 1) == ":" and s.at(i + 2) != ":":
            return None
        if s.at(i + 1) == "(" and s.toks[i].end == s.toks[i + 1].start:
            return s.at(i), "call", i
        spaced = i + 1 < len(s.toks) and s.toks[i + 1].start > s.toks[i].end
        argument = s.kind(i + 1) in ("str", "num") or s.kind(i + 1) == "id" and s.at(i + 1) not in ("if", "unless", "while", "until", "and", "or", "do", "then", "rescue", "in", "end") or s.at(i + 1) in (":", "@") and spaced
        if i in self.fresh and spaced and argument and s.at(i)[0].islower():
            return s.at(i), "call", i
        return None


class Lua(Reader):
    family = "lua"
    calls = False

    def define(self, i: int) -> Def | None:
        s = self.s
        if s.at(i) != "function" or s.kind(i + 1) != "id":
            return None
        first = i - 1 if s.at(i - 1) == "local" else i
        j = i + 1
        while s.at(j + 1) in (".", ":") and s.kind(j + 2) == "id":
            j += 2
        depth, k = 0, i
        while k < len(s.toks):
            t = s.at(k)
            if t in ("function", "if", "do", "repeat"):
                depth += 1
            elif t in ("end", "until"):
                depth -= 1
                if depth == 0:
                    break
            k += 1
        body = s.close.get(j + 1, j + 1) + 1
        return Def("function", s.text[s.toks[i + 1].start : s.toks[j].end], first, min(k, len(s.toks) - 1), body if body < k else None)


class Bash(Reader):
    family = "shell"
    calls = False
    ident = r"[A-Za-z_][\w:-]*"

    def define(self, i: int) -> Def | None:
        s = self.s
        if s.kind(i) == "id" and s.at(i + 1) == "(" and s.at(i + 2) == ")" and s.at(i + 3) in ("{", "("):
            first = i - 1 if s.at(i - 1) == "function" else i
            return Def("function", s.at(i), first, s.close[i + 3], i + 3)
        if s.at(i) == "function" and s.kind(i + 1) == "id" and s.at(i + 2) == "{":
            return Def("function", s.at(i + 1), i, s.close[i + 2], i + 2)
        return None


class LetBound(Indented):
    """let name ... = value, type and module definitions."""

    module_kind, type_kind = "class", "type"

    def define(self, i: int) -> Def | None:
        s, t = self.s, self.s.at(i)
        if t in ("let", "and") and (t == "let" or self.scopes or s.place(s.toks[i].start)[1] == 0):
            j = i + 1 + (s.at(i + 1) == "rec")
            if s.at(j) == "(" and s.at(j + 1) == ")":
                name, end = "()", j + 1
            elif s.kind(j) == "id":
                name, end = s.at(j), j
            else:
                return None
            if not self.binds(end + 1):
                return None
            return Def("function", name, i + 1 if t == "let" and s.at(i + 1) != "rec" else j, self.binding_end(end + 1, i))
        if t == "type" and s.at(i - 1) not in ("module",):
            j = i + 1 + (s.at(i + 1) in ("rec", "nonrec"))
            while s.kind(j) == "str" or s.at(j) in ("'",):
                j += 1
            if s.kind(j) == "id":
                return Def("type", s.at(j), i, self.binding_end(j, i))
        if t == "module" and s.at(i - 1) != "=":
            j = i + 1 + (s.at(i + 1) in ("rec", "type"))
            if s.kind(j) == "id" and s.at(i + 1) != "type":
                return Def("class", s.at(j), i, self.binding_end(j, i))
        return None

    def binds(self, j: int) -> bool:
        s = self.s
        while j < len(s.toks):
            if s.at(j) == "=":
                return True
            if s.at(j) in ("let", "in", ";", "}", ")"):
                return False
            j = s.close[j] + 1 if j in s.close else j + 1
        return False

    def binding_end(self, j: int, first: int) -> int:
        """Up to the next binding of the same line or a line that is not further in."""
        s = self.s
        col = s.place(s.toks[first].start)[1]
        depth = 0
        while j < len(s.toks):
            if j in s.close:
                j = s.close[j]
            nxt = j + 1
            if nxt >= len(s.toks) or s.at(nxt) in ("}", ")", "]"):
                return j
            if s.at(j) in ("struct", "sig", "begin", "object"):
                depth += 1
            if s.at(nxt) == "end":
                if depth == 0:
                    return j
                depth -= 1
            if s.at(nxt) == "in" and depth == 0:
                return j
            if not s.same_line(j, nxt) and s.place(s.toks[nxt].start)[1] <= col and s.at(nxt) not in ("end", "->", "|"):
                return j
            j = nxt
        return len(s.toks) - 1


class OCaml(LetBound):
    family = "ml"
    calls = False
    ident = r"[A-Za-z_\u0080-\U0010FFFF][\w']*"


class ReScript(LetBound):
    family = "jvm"
    member_calls = False
    keywords = Reader.keywords | frozenset("let switch module type".split())


_READERS = {
    "typescript": TypeScript, "tsx": TypeScript, "javascript": JavaScript, "python": Python, "go": Go, "rust": Rust, "java": Java, "ruby": Ruby,
    "c": C, "cpp": Cpp, "csharp": CSharp, "php": Php, "scala": Scala, "solidity": Solidity, "zig": Zig, "kotlin": Kotlin, "objc": ObjectiveC,
    "lua": Lua, "bash": Bash, "ocaml": OCaml, "rescript": ReScript,
}
assert set(_READERS) == set(LANGUAGES)


def parse_source(lang: str, text: str) -> Parsed:
    """Raises ValueError for a language that is not known; for nothing else."""
    if lang not in _READERS:
        raise ValueError(f"Unknown language: {lang}")
    return _READERS[lang](text or "").read(lang)

"""Tokens of source text in many languages. Nothing here fails on broken text."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # "id", "num", "str", "op" or "nl"
    text: str
    start: int
    end: int


#: How a language family writes comments and strings. ``line`` and ``block`` are comments, ``raw`` further string patterns.
_FAMILIES = {
    "c": {"line": [r"//[^\n]*"], "block": [r"/\*.*?(?:\*/|\Z)"], "raw": [r"@\"(?:[^\"]|\"\")*\"", r"R\"\((?:.*?)\)\""]},
    "js": {"line": [r"//[^\n]*"], "block": [r"/\*.*?(?:\*/|\Z)"], "raw": []},
    "go": {"line": [r"//[^\n]*"], "block": [r"/\*.*?(?:\*/|\Z)"], "raw": [r"`[^`]*(?:`|\Z)"]},
    "rust": {"line": [r"//[^\n]*"], "block": [r"/\*.*?(?:\*/|\Z)"], "raw": [r"b?r#\".*?(?:\"#|\Z)", r"b?r\"[^\"]*\"", r"b?'(?:\\[^\n]+?|[^\\'\n])'", r"'[A-Za-z_]\w*"]},
    "jvm": {"line": [r"//[^\n]*"], "block": [r"/\*.*?(?:\*/|\Z)"], "raw": [r"\"\"\".*?(?:\"\"\"|\Z)", r"'[A-Za-z_]\w*(?!')"]},
    "php": {"line": [r"//[^\n]*", r"#(?!\[)[^\n]*"], "block": [r"/\*.*?(?:\*/|\Z)"], "raw": []},
    "python": {"line": [r"#[^\n]*"], "block": [], "raw": [r"[rRbBuUfF]{0,2}\"\"\".*?(?:\"\"\"|\Z)", r"[rRbBuUfF]{0,2}'''.*?(?:'''|\Z)", r"[rRbBuUfF]{1,2}\"(?:\\.|[^\"\\\n])*\"", r"[rRbBuUfF]{1,2}'(?:\\.|[^'\\\n])*'"]},
    "ruby": {"line": [r"#[^\n]*"], "block": [r"^=begin\b.*?(?:^=end\b|\Z)"], "raw": [r":\"(?:\\.|[^\"\\\n])*\"", r"<<[~-]?(['\"]?)(?P<doc>[A-Z_]\w*)\1.*?(?:^\s*(?P=doc)\b|\Z)"]},
    "shell": {"line": [r"(?<![\w$\{])#[^\n]*"], "block": [], "raw": [r"<<-?\s*(['\"]?)(?P<doc>\w+)\1\n.*?(?:^\s*(?P=doc)\b|\Z)"]},
    "lua": {"line": [r"--(?!\[\[)[^\n]*"], "block": [r"--\[\[.*?(?:\]\]|\Z)"], "raw": [r"\[\[.*?(?:\]\]|\Z)"]},
    "ml": {"line": [], "block": [r"\(\*.*?(?:\*\)|\Z)"], "raw": [r"'(?:\\[^\n]+?|[^\\'\n])'", r"'[a-z_]\w*"]},
}
_OPS = r"===|!==|=>|->|::|\?\.|&\.|\?->|\.\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|:=|\+\+|--|<-"


@lru_cache(maxsize=None)
def _pattern(family: str, ident: str) -> re.Pattern:
    f = _FAMILIES[family]
    strings = [*f["raw"], r"\"(?:\\.|[^\"\\\n])*\"", r"'(?:\\.|[^'\\\n])*'"]
    if family == "shell":
        strings = [*f["raw"], r"\"(?:\\.|[^\"\\])*\"", r"'[^']*'"]
    parts = [f"(?P<skip>{'|'.join([*f['line'], *f['block']]) or '(?!)'})", f"(?P<str>{'|'.join(strings)})", f"(?P<id>{ident})", r"(?P<num>\d[\w.]*)", r"(?P<nl>\n)", rf"(?P<op>{_OPS}|[^\s])"]
    return re.compile("|".join(parts), re.S | re.M)


def tokens(text: str, family: str, ident: str = r"[A-Za-z_$\u0080-\U0010FFFF][\w$]*", newlines: bool = False) -> list[Token]:
    if family == "js":
        return _js_tokens(text, ident)
    out = []
    for m in _pattern(family, ident).finditer(text):
        kind = "skip" if m.group("skip") is not None else "str" if m.group("str") is not None else "id" if m.group("id") is not None else "num" if m.group("num") is not None else "nl" if m.group("nl") is not None else "op"
        if kind == "skip" or kind == "nl" and not newlines:
            continue
        out.append(Token(kind, m.group(), m.start(), m.end()))
    return out


_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > => && || == === != !== return typeof case in of delete void throw new".split())
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _js_tokens(text: str, ident: str) -> list[Token]:
    """As above, but / may begin a pattern, and code inside ${...} of a template is code."""
    out: list[Token] = []
    pattern, at, n = _pattern("js", ident), 0, len(text)
    depth: list[int] = []  # open braces since each ${

    def template(at: int) -> int:
        start = at
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                out.append(Token("str", text[start:at], start, at))
                return at + 1
            elif text.startswith("${", at):
                out.append(Token("str", text[start:at], start, at))
                out.append(Token("op", "(", at, at + 2))
                depth.append(0)
                return at + 2
            else:
                at += 1
        return n

    while at < n:
        c = text[at]
        if c == "`":
            at = template(at + 1)
            continue
        if c == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            out.append(Token("str", m.group(), at, m.end()))
            at = m.end()
            continue
        if depth and c == "{":
            depth[-1] += 1
        elif depth and c == "}":
            if depth[-1] == 0:
                depth.pop()
                out.append(Token("op", ")", at, at + 1))
                at = template(at + 1)
                continue
            depth[-1] -= 1
        m = pattern.match(text, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m.group("skip") is None and m.group("nl") is None:
            kind = "str" if m.group("str") is not None else "id" if m.group("id") is not None else "num" if m.group("num") is not None else "op"
            out.append(Token(kind, m.group(), m.start(), m.end()))
    return out


class Source:
    """Tokens with their bracket partners, and places as rows and columns."""

    PAIRS = {"(": ")", "[": "]", "{": "}"}

    def __init__(self, text: str, toks: list[Token]):
        self.text, self.toks = text, toks
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        self.parent: list[int] = []  # innermost open bracket around each token, or -1
        stack: list[int] = []
        self.open: dict[int, int] = {}
        for i, t in enumerate(toks):
            if t.kind == "op" and t.text in (")", "]", "}"):
                # a closer without its opener inside the innermost braces is left alone
                k = len(stack) - 1
                while k >= 0 and self.PAIRS[toks[stack[k]].text] != t.text:
                    k -= 1
                if k >= 0:
                    for o in stack[k + 1 :]:
                        self.close[o] = i - 1
                    self.close[stack[k]], self.open[i] = i, stack[k]
                    del stack[k:]
            self.parent.append(stack[-1] if stack else -1)
            if t.kind == "op" and t.text in self.PAIRS:
                stack.append(i)
        for o in stack:
            self.close[o] = len(toks) - 1
        self._wide = [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", text)]

    def place(self, offset: int) -> tuple[int, int]:
        row = bisect_right(self.lines, offset) - 1
        return row, self.units(offset) - self.units(self.lines[row])

    def units(self, offset: int) -> int:
        """UTF-16 units before a place."""
        return offset + bisect_right(self._wide, offset - 1)

    def at(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < len(self.toks) else ""

    def same_line(self, i: int, j: int) -> bool:
        return "\n" not in self.text[self.toks[i].end : self.toks[j].start]

    def line_end(self, i: int) -> int:
        """The last token of the logical line of token i: brackets that open in it are passed over."""
        n = len(self.toks)
        while True:
            if i in self.close:
                i = self.close[i]
            if i + 1 >= n or not self.same_line(i, i + 1) or self.at(i + 1) in (")", "]", "}", ";"):
                return i
            i += 1

    def angle(self, i: int) -> int:
        """Behind <...> that begins at token i, or i if there is none."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.toks) and j < i + 200:
            t = self.at(j)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif t in (";", "{", "}", "&&", "||"):
                return i
            elif t in ("(", "["):
                j = self.close.get(j, j)
            j += 1
        return i

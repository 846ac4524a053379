"""Declarations and calls of JavaScript, TypeScript and Go, from tokens that know strings, comments, templates and brackets.

A file becomes a list of tokens with the place of each bracket's partner, so a brace in a string or a comment closes nothing. Declarations
are read by descent: statements of the file, members of classes, bodies. Calls belong to the innermost declaration that is a unit; those
inside a nested function, callback or class belong to none.
"""

from __future__ import annotations

import re
from typing import NamedTuple

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words before a parenthesis that call nothing, and words after which a slash opens a pattern. Fixed values.
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "function", "func", "await", "typeof", "super", "import", "go", "defer", "range", "case", "select", "in", "of", "new", "throw", "else", "do", "yield", "void", "delete"}
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "yield", "await"}
MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor"}
_TOKEN = re.compile(r"""(?P<skip>[^\S\n]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<line>\n)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<id>[#@]?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<num>\d[\w.]*)|(?P<p>=>|\?\.|:=|\.\.\.|.)""", re.DOTALL)
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


class Token(NamedTuple):
    kind: str  # id, str, num, re or p
    text: str
    line: int


def tokens(source: str, lang: str) -> list[Token]:
    """All tokens; a template's text is left out and its expressions stand between braces."""
    out: list[Token] = []
    at, line, deep = 0, 1, []  # deep: for each open template expression the braces inside it
    while at < len(source):
        c = source[at]
        if c == "`" and lang == "go":
            end = source.find("`", at + 1) % (len(source) + 1)
            out.append(Token("str", source[at : end + 1], line))
            line, at = line + source.count("\n", at, end), end + 1
            continue
        if c == "`" or (c == "}" and deep and deep[-1] == 0):
            if c == "`":
                out.append(Token("str", "``", line))
            else:
                out.append(Token("p", "}", line))
                deep.pop()
            at += 1
            while at < len(source) and source[at] != "`" and source[at : at + 2] != "${":
                line += source[at] == "\n"
                at += 1 + (source[at] == "\\" and source[at + 1 : at + 2] != "\n")
            if source[at : at + 2] == "${":
                out.append(Token("p", "{", line))
                deep.append(0)
                at += 1
            at += 1
            continue
        if c == "/" and lang != "go" and (not out or out[-1].text in BEFORE_PATTERN or (out[-1].kind == "p" and out[-1].text not in (")", "]", "}", "<"))) and (m := _PATTERN.match(source, at)):
            out.append(Token("re", m[0], line))
            at = m.end()
            continue
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        if deep and text in "{}" and kind == "p":
            deep[-1] += 1 if text == "{" else -1
        if kind not in ("skip", "line"):
            out.append(Token(kind, text, line))
        line, at = line + text.count("\n"), m.end()
    return out


def partners(held: list[Token]) -> dict[int, int]:
    """The place of each bracket's partner; one without has the last place."""
    out, stack = {}, []
    for k, t in enumerate(held):
        if t.kind == "p" and t.text in OPEN:
            stack.append(k)
        elif t.kind == "p" and t.text in CLOSE:
            while stack and held[stack[-1]].text != CLOSE[t.text]:
                out[stack.pop()] = k
            if stack:
                out[k] = stack[-1]
                out[stack.pop()] = k
    return out | dict.fromkeys(stack, len(held) - 1)


class Source:
    """A file's tokens with moves over them."""

    def __init__(self, source: str, lang: str):
        self.t = tokens(source, lang)
        self.end = partners(self.t)
        self.lang = lang

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_id(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "id"

    def after_generics(self, k: int) -> int:
        """Past `<...>`, or past `[...]` in Go, where one stands at k."""
        if self.text(k) == "[" and self.lang == "go":
            return self.end[k] + 1
        depth = 0
        while self.text(k) == "<" or depth:
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            k = self.end[k] + 1 if self.text(k) in OPEN and k in self.end else k + 1
            if k >= len(self.t):
                return k
        return k

    def body(self, k: int) -> int | None:
        """The brace that opens the body after a parameter list that ended before k: past a result type, whose own braces are passed over."""
        typed = False
        while k < len(self.t):
            x = self.text(k)
            if x == "{":
                before = self.text(k - 1)
                if not (before in ("interface", "struct") or (typed and before in (":", "|", "&", "<", ","))):
                    return k
                k = self.end[k] + 1
            elif x in (";", "}", ")") or (x in ("=>", "=") and not typed) or (self.is_id(k) and x in ("func", "type", "function", "class", "var", "const", "import", "export")):
                return None
            else:
                typed = typed or x == ":"
                k = self.end[k] + 1 if x in ("(", "[") and k in self.end else k + 1
        return None

    def calls(self, start: int, stop: int) -> list[dict]:
        """Calls between two places without those of nested functions and classes."""
        out, k = [], start
        while k < stop:
            x = self.text(k)
            if x in ("function", "func") and self.t[k].kind == "id":
                p = k + 1
                while p < stop and self.text(p) != "(":
                    p += 1
                b = self.body(self.end.get(p, stop) + 1) if p < stop else None
                k = self.end.get(b, stop) + 1 if b is not None else p + 1
                continue
            if x == "class" and self.t[k].kind == "id" and (b := self.body(k + 1)) is not None:
                k = self.end[b] + 1
                continue
            if x == "=>":
                k = self.arrow_end(k + 1, stop)
                continue
            if self.t[k].kind == "id" and (x not in NOT_CALLED or self.text(k - 1) in (".", "?.")) and self.text(k + 1) == "(" and self.text(k - 1) not in ("new", "function", "func"):
                if self.text(self.end[k + 1] + 1) == "{" and self.lang != "go":  # a method of an object
                    k = self.end[self.end[k + 1] + 1] + 1
                    continue
                out.append({"receiver": self.receiver(k), "name": x, "line": self.t[k].line})
            k += 1
        return out

    def arrow_end(self, k: int, stop: int) -> int:
        """The place after an arrow function's body that begins at k."""
        if self.text(k) == "{":
            return self.end[k] + 1
        first = k
        while k < stop and self.text(k) not in (",", ";", ")", "]", "}") and not (k > first and self.new_statement(k)):
            k = self.end[k] + 1 if self.text(k) in OPEN and k in self.end else k + 1
        return k

    def new_statement(self, k: int) -> bool:
        """Whether a word on a new line follows what can end a value."""
        before = self.t[k - 1]
        return self.is_id(k) and self.t[k].line > before.line and (before.kind != "p" or before.text in CLOSE)

    def receiver(self, k: int) -> str | None:
        """The first segment of what the call's name is read from, null for a bare name."""
        first = None
        while self.text(k - 1) in (".", "?."):
            k -= 2
            stop = k + 1
            while self.text(k) in CLOSE and k in self.end:
                k = self.end[k] - 1
                if not self.is_id(k) and self.text(k) not in CLOSE:
                    k += 1
                    break
            first = "".join(t.text for t in self.t[max(k, 0) : stop])
        return first

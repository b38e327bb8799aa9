"""Tokens of TypeScript and JavaScript with JSX: enough to find declarations, imports and decisions.

Strings, templates, regular expressions, comments and JSX text are told apart from code, so brackets can be matched.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, tmpl, regex, jsx, punct
    text: str
    start: int
    end: int


class Comment(NamedTuple):
    text: str
    start: int
    end: int


_SPACE = re.compile(r"\s+")
_ID = re.compile(r"#?[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_NUM = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STR = re.compile(r"'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PUNCT = re.compile(r"\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||=>|===|!==|==|!=|\.\.\.|<=|>=|\*\*=?|\+\+|--|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof", "default", "extends"}
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=[^>])")


class Lexer:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self.comments: list[Comment] = []

    def run(self) -> Lexer:
        if self.text.startswith("#!"):
            n = self.text.find("\n")
            self._code(n if n >= 0 else len(self.text), None)
        else:
            self._code(0, None)
        return self

    def _value_next(self) -> bool:
        """Whether an expression may begin here (so / is a regular expression and < may open an element)."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "id":
            return t.text in _BEFORE_VALUE
        return t.kind == "punct" and t.text not in (")", "]", "}", "++", "--")

    def _code(self, at: int, until: str | None) -> int:
        """Lex from ``at``; with ``until``, stop behind the bracket that closes the level."""
        text, n, depth = self.text, len(self.text), 0
        add = self.tokens.append
        while at < n:
            c = text[at]
            if c.isspace():
                at = _SPACE.match(text, at).end()
            elif c == "/" and text.startswith("//", at):
                end = text.find("\n", at)
                end = n if end < 0 else end
                self.comments.append(Comment(text[at:end], at, end))
                at = end
            elif c == "/" and text.startswith("/*", at):
                end = text.find("*/", at + 2)
                end = n if end < 0 else end + 2
                self.comments.append(Comment(text[at:end], at, end))
                at = end
            elif c in "'\"":
                m = _STR.match(text, at)
                add(Token("str", m[0], at, m.end()))
                at = m.end()
            elif c == "`":
                at = self._template(at)
            elif m := _ID.match(text, at):
                add(Token("id", m[0], at, m.end()))
                at = m.end()
            elif (c.isdigit() or c == ".") and (m := _NUM.match(text, at)) and m[0] != ".":
                add(Token("num", m[0], at, m.end()))
                at = m.end()
            elif c == "/" and self._value_next() and (m := _REGEX.match(text, at)):
                add(Token("regex", m[0], at, m.end()))
                at = m.end()
            elif c == "<" and self.jsx and self._value_next() and (text[at + 1 : at + 2] == ">" or _TAG.match(text, at + 1)) and not _GENERIC.match(text, at):
                at = self._element(at)
            else:
                m = _PUNCT.match(text, at)
                if m is None:
                    at += 1
                    continue
                add(Token("punct", m[0], at, m.end()))
                at = m.end()
                if until:
                    if m[0] == "{":
                        depth += 1
                    elif m[0] == "}":
                        if depth == 0:
                            return at
                        depth -= 1
        return at

    def _template(self, at: int) -> int:
        text, n, start = self.text, len(self.text), at
        self.tokens.append(Token("tmpl", "`", at, at + 1))
        at += 1
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif text.startswith("${", at):
                self.tokens.append(Token("punct", "{", at, at + 2))
                at = self._code(at + 2, "}")
                self.tokens.append(Token("tmpl", "`", start, at))
            else:
                at += 1
        return at

    def _element(self, at: int) -> int:
        """One element or fragment from its < to the end of its closing tag."""
        text, n, start = self.text, len(self.text), at
        m = _TAG.match(text, at + 1)
        self.tokens.append(Token("jsx", m[0] if m else "", start, start + 1))
        at = m.end() if m else at + 1
        while at < n:  # attributes
            c = text[at]
            if c == ">":
                at += 1
                break
            if text.startswith("/>", at):
                return at + 2
            if c in "'\"":
                end = text.find(c, at + 1)
                at = n if end < 0 else end + 1
            elif c == "{":
                self.tokens.append(Token("punct", "{", at, at + 1))
                at = self._code(at + 1, "}")
            else:
                at += 1
        while at < n:  # children
            if text.startswith("</", at):
                end = text.find(">", at)
                self.tokens.append(Token("jsx", "", start, n if end < 0 else end + 1))
                return n if end < 0 else end + 1
            c = text[at]
            if c == "<":
                at = self._element(at)
            elif c == "{":
                self.tokens.append(Token("punct", "{", at, at + 1))
                at = self._code(at + 1, "}")
            else:
                at += 1
        return at


def lex(text: str, path: str = "a.ts") -> Lexer:
    return Lexer(text, not path.endswith((".ts", ".mts", ".cts"))).run()

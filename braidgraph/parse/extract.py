"""What a source file imports and exports, from its tokens."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from .lexer import Comment, Lexer, Token, lex

_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}
_GOES_ON = {"as", "satisfies", "in", "instanceof", "extends", "is", "keyof", "of", "from", "implements"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async"}
_DOC_LIMIT = 200


@dataclass
class Import:
    specifier: str
    line: int
    type: str  # import, re-export, dynamic
    importSpecifier: str
    kind: str  # value, type-only


@dataclass
class Module:
    name: str
    metadata: dict


@dataclass
class Parsed:
    imports: list[Import] = field(default_factory=list)
    modules: list[Module] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _unquoted(token: Token) -> str:
    return re.sub(r"\\(.)", r"\1", token.text[1:-1])


class _File:
    def __init__(self, path: str, text: str):
        self.text = text
        lexed: Lexer = lex(text, path)
        self.t, self.comments = lexed.tokens, lexed.comments
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        self.depth: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "punct" and t.text in _CLOSE:
                if stack:
                    self.match[stack.pop()] = i
                self.depth.append(len(stack))
            else:
                self.depth.append(len(stack))
                if t.kind == "punct" and t.text in _OPEN:
                    stack.append(i)
        self.at_comment = [c.start for c in self.comments]

    def line(self, pos: int) -> int:
        return bisect.bisect_left(self.lines, pos) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts and self.t[i].kind in ("id", "punct")

    def new_line(self, i: int) -> bool:
        return i > 0 and self.line(self.t[i - 1].end - 1) < self.line(self.t[i].start)

    def begins(self, i: int) -> bool:
        """Whether token i begins a statement, by semicolons, braces and line breaks."""
        if i == 0:
            return True
        p, t = self.t[i - 1], self.t[i]
        if p.kind == "punct" and (p.text == ";" or p.text == "}" and self.new_line(i)):
            return t.kind == "id" or t.text == "@" or p.text == ";"
        if not self.new_line(i) or t.kind != "id" or t.text in _GOES_ON:
            return p.kind == "punct" and p.text == "}" and t.kind == "id" and t.text in ("export", "import", "const", "let", "var", "function", "class", "interface", "enum", "async", "abstract", "declare")
        return p.kind != "punct" or p.text in (")", "]", "}", ">")

    def statement_end(self, i: int) -> int:
        """Index behind the last token of a statement that runs to a semicolon or a line break."""
        level = self.depth[i]
        j = i + 1
        while j < len(self.t):
            if self.depth[j] < level:
                return j
            if self.depth[j] == level:
                if self.is_(j, ";"):
                    return j
                if self.begins(j):
                    return j
            j = self.match.get(j, j) + 1 if self.t[j].text in _OPEN and self.t[j].kind == "punct" else j + 1
        return j

    def docs(self, i: int) -> list[Comment]:
        """Comments between the token before i and i that lead it (those on the other's line trail that one)."""
        low = self.t[i - 1].end if i else 0
        out, k = [], bisect.bisect_left(self.at_comment, low)
        broke = i == 0
        while k < len(self.comments) and self.comments[k].start < self.t[i].start:
            c = self.comments[k]
            broke = broke or "\n" in self.text[low : c.start]
            if broke:
                out.append(c)
            k += 1
        return out


def _doc(comments: list[Comment]) -> str | None:
    for c in comments:
        if c.text.startswith("/**"):
            lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in c.text[3:-2].strip().split("\n")]
            body = "\n".join(lines)
            return body[:_DOC_LIMIT] + "..." if len(body) > _DOC_LIMIT else body or None
    return None


def _deprecated(comments: list[Comment]) -> bool:
    return any(c.text.startswith("/**") and re.search("@deprecated", c.text, re.I) for c in comments)


def complexity(f: _File, a: int, b: int) -> int:
    """1 and one for each decision among the tokens [a, b): if, last else, loop, case, catch, logical operator, conditional."""
    n = 1
    for i in range(a, b):
        t = f.t[i]
        if t.kind == "id":
            if f.is_(i - 1, ".", "?.") or t.text != "case" and f.is_(i + 1, ":") and f.is_(i - 1, "{", ","):
                continue
            opens = f.is_(i + 1, "(", "await") or t.text == "catch" and f.is_(i + 1, "{")
            if t.text in ("if", "for", "while", "catch") and opens and not (t.text == "if" and f.is_(i - 1, "else")) or t.text == "case" and not f.is_(i + 1, ":", ","):
                n += 1
            elif t.text == "else" and not f.is_(i + 1, "if"):
                n += 1
        elif t.kind == "punct":
            # a question mark before these is an optional name of a type or parameter
            optional = f.is_(i + 1, ":", ")", ",", "=", ";") or f.is_(i + 1, "(", "<") and f.is_(i - 1, "(", ",")
            if t.text in ("&&", "||", "??") or t.text == "?" and not optional:
                n += 1
    return n


def lines_of_code(text: str) -> int:
    n, inside = 0, False
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            continue
        if "/*" in line and "*/" in line:
            n += bool(re.sub(r"/\*.*?\*/", "", line).strip())
        elif line.startswith("/*"):
            inside = True
        elif inside:
            inside = not line.endswith("*/")
        elif not line.startswith("//"):
            n += 1
    return n


def _names(f: _File, a: int) -> list[tuple[str, str]]:
    """(exported or local name, original name) of a braced list that opens at a."""
    out, i, end = [], a + 1, f.match.get(a, len(f.t))
    while i < end:
        item = []
        while i < end and not f.is_(i, ","):
            item.append(f.t[i])
            i += 1
        i += 1
        words = [_unquoted(t) if t.kind == "str" else t.text for t in item]
        if len(words) > 1 and words[0] == "type" and words[1] != "as":
            words = words[1:]
        if words:
            out.append((words[2] if len(words) > 2 and words[1] == "as" else words[0], words[0]))
    return out


def _import(f: _File, i: int, out: Parsed) -> int:
    """An import declaration at i; returns the index behind it."""
    start, j = i, i + 1
    kind = "value"
    if f.is_(j, "type") and not (f.is_(j + 1, "from") and j + 2 < len(f.t) and f.t[j + 2].kind == "str") and not f.is_(j + 1, ",", "="):
        kind, j = "type-only", j + 1
    if j < len(f.t) and f.t[j].kind == "str":
        shape = "empty"
    else:
        shape = "empty"
        if j < len(f.t) and f.t[j].kind == "id":
            shape = "default"
            j += 1
            if f.is_(j, "="):
                return f.statement_end(start)
            if f.is_(j, ","):
                j += 1
        if f.is_(j, "*"):
            shape = "namespace" if shape == "empty" else shape
            j += 3
        elif f.is_(j, "{"):
            if shape == "empty":
                shape = "named:" + ",".join(n for n, _ in _names(f, j))
            j = f.match.get(j, j) + 1
        if not f.is_(j, "from"):
            return f.statement_end(start)
        j += 1
    if j < len(f.t) and f.t[j].kind == "str":
        spec = _unquoted(f.t[j])
        if spec.strip():
            out.imports.append(Import(spec, f.line(f.t[start].start), "import", shape, kind))
    return f.statement_end(start)


def _function_shape(f: _File, a: int, b: int) -> tuple[bool, str, str | None]:
    """(is a function, text of its return type, its own name) of an initializer in tokens [a, b)."""
    i = a
    if f.is_(i, "async"):
        i += 1
    if f.is_(i, "function"):
        i += 1
        if f.is_(i, "*"):
            i += 1
        name = f.t[i].text if i < b and f.t[i].kind == "id" else None
        while i < b and not f.is_(i, "("):
            i += 1
        close = f.match.get(i, i)
        j = close + 1
        while j < b and not f.is_(j, "{"):
            j += 1
        return True, f.text[f.t[close].end : f.t[j].start] if j < b else "", name
    if f.is_(i, "<"):
        depth = 0
        while i < b:
            depth += f.is_(i, "<") - f.is_(i, ">")
            i += 1
            if depth == 0:
                break
    if i < b and f.t[i].kind == "id" and f.is_(i + 1, "=>"):
        return True, "", None
    if f.is_(i, "("):
        close = f.match.get(i, i)
        j = close + 1
        if f.is_(j, "=>"):
            return True, "", None
        if f.is_(j, ":"):
            while j < b and not f.is_(j, "=>"):
                if f.is_(j, "=", ";"):
                    return False, "", None
                j = f.match.get(j, j) + 1 if f.is_(j, *_OPEN) else j + 1
            if j < b:
                return True, f.text[f.t[close].end : f.t[j].start], None
    return False, "", None


def _has_jsx(f: _File, a: int, b: int) -> bool:
    return any(t.kind == "jsx" and t.text for t in f.t[a:b])


def parse(path: str, text: str) -> Parsed:
    """Imports in order, and exported symbols: declarations first, then names of export lists."""
    f, out = _File(path, text), Parsed()
    exported: dict[str, dict] = {}
    declared: list[tuple] = []  # (start, first token of the node, end, kind, name, has name, default, direct)
    lists: list[tuple] = []  # (names, re-exported)
    skip: list[tuple[int, int]] = []
    i, n = 0, len(f.t)
    while i < n:
        if f.depth[i] or not f.begins(i):
            i += 1
            continue
        t = f.t[i]
        if t.kind == "id" and t.text == "import" and not f.is_(i + 1, "(", "."):
            end = _import(f, i, out)
            skip.append((i, end))
            i = max(end, i + 1)
            continue
        j, mods = i, []
        while f.is_(j, "@"):
            j += 2
            while f.is_(j, "."):
                j += 2
            if f.is_(j, "("):
                j = f.match.get(j, j) + 1
        while j < n and f.t[j].kind == "id" and f.t[j].text in _MODIFIERS and j + 1 < n and not f.is_(j + 1, "=", ".", "(", ":"):
            if f.t[j].text == "async" and not f.is_(j + 1, "function"):
                break
            mods.append(f.t[j].text)
            j += 1
        word = f.t[j].text if j < n else ""
        direct, default = "export" in mods or "default" in mods, "default" in mods
        if "export" in mods and (word in ("{", "*") or word == "type" and f.is_(j + 1, "{", "*")):
            kind = "value"
            if word == "type":
                kind, j = "type-only", j + 1
            names = None
            if f.is_(j, "*"):
                shape, k = "wildcard", j + 1
                if f.is_(k, "as"):
                    k += 2
            else:
                names = _names(f, j)
                shape, k = "named:" + ",".join(a for a, _ in names), f.match.get(j, j) + 1
            source = f.t[k + 1] if f.is_(k, "from") and k + 1 < n and f.t[k + 1].kind == "str" else None
            if source:
                spec = _unquoted(source)
                if spec.strip():
                    out.imports.append(Import(spec, f.line(t.start), "re-export", shape, kind))
            if names is not None:
                lists.append((names, source is not None))
                if not source:
                    for a, b in names:
                        one = exported.setdefault(b, {"names": [], "types": []})
                        one["names"].append(a)
                        one["types"].append("default" if a == "default" else "named")
            end = k + 2 if source else k
            skip.append((i, end))
            i = end
            continue
        if "export" in mods and f.is_(j, "="):
            j, default = j + 1, True
            word = f.t[j].text if j < n else ""
        named = lambda k: k < n and f.t[k].kind == "id"
        if word == "const" and f.is_(j + 1, "enum"):
            j, word = j + 1, "enum"
        if word in ("function", "class", "interface", "enum") and (named(j + 1) or word in ("function", "class")):
            k = j + 1 + (word == "function" and f.is_(j + 1, "*"))
            name = f.t[k].text if named(k) and f.t[k].text not in ("extends", "implements") else None
            body = k
            level = f.depth[j]
            while body < n and not (f.is_(body, "{") and f.depth[body] == level and not f.is_(body - 1, ":", "<", "|", "&", ",", "=>")):
                if f.is_(body, ";") and f.depth[body] == level:
                    break
                body = f.match.get(body, body) + 1 if f.is_(body, "(", "[", "{") else body + 1
            end = (f.match.get(body, body) + 1) if f.is_(body, "{") else body + (f.is_(body, ";"))
            if name or default:
                declared.append((i, j, min(end, n), word, name, default, direct))
            i = max(end, i + 1)
            continue
        if word == "type" and named(j + 1) and (f.is_(j + 2, "=", "<")):
            end = f.statement_end(j)
            declared.append((i, j, end, "type", f.t[j + 1].text, default, direct))
            i = max(end, i + 1)
            continue
        if word in ("const", "let", "var") and not default:
            end = f.statement_end(j)
            declared.append((i, j, end, "var", None, False, direct))
            i = max(end, i + 1)
            continue
        if default and named(j) and "export" in mods:
            k = j + 1
            if k >= n or f.is_(k, ";") or f.begins(k):
                one = exported.setdefault(word, {"names": [], "types": []})
                one["names"].append(word)
                one["types"].append("default")
        i = max(j, i + 1)

    seen: dict[str, int] = {}

    def add(name: str, meta: dict) -> None:
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.modules.append(Module(f"{name}_{count}" if count else name, {"kind": "variable", "isExported": True} | {k: v for k, v in meta.items() if v not in (None, False)}))

    def described(first: int, kind: str, a: int, b: int, start: int, end: int) -> dict:
        docs = f.docs(first)
        meta = {"kind": kind, "deprecated": _deprecated(docs), "jsDoc": _doc(docs)}
        if kind in ("function", "component"):
            meta |= {"complexity": complexity(f, a, b), "loc": lines_of_code(f.text[start:end])}
        return meta

    for i, j, end, word, name, default, direct in declared:
        if word == "var":
            spans, a, k = [], j + 1, j + 1
            while k <= end:
                if k == end or (f.is_(k, ",") and f.depth[k] == f.depth[j]):
                    if k > a:
                        spans.append((a, k))
                    a = k + 1
                k = f.match.get(k, k) + 1 if k < end and f.is_(k, *_OPEN) else k + 1
            parts = []
            for a, b in spans:
                k = a
                while k < b and not f.is_(k, ":", "=", "!"):
                    k = f.match.get(k, k) + 1 if f.is_(k, *_OPEN) else k + 1
                label = f.text[f.t[a].start : f.t[k - 1].end]
                while k < b and not (f.is_(k, "=") and f.depth[k] == f.depth[a]):
                    k = f.match.get(k, k) + 1 if f.is_(k, *_OPEN) else k + 1
                parts.append((label, a, b, k + 1 if k < b else None))
            if not parts or not (direct or parts[0][0] in exported):
                continue
            for label, a, b, init in parts:
                kind = "variable"
                if init is not None:
                    is_function, returns, own = _function_shape(f, init, b)
                    if is_function:
                        component = not (own or "").startswith("use") and ("JSX.Element" in returns or "ReactElement" in returns or _has_jsx(f, init, b))
                        kind = "component" if component else "function"
                    elif f.t[init].kind == "jsx" and f.t[init].text if init < b else False:
                        kind = "component"
                add(label, described(a, kind, a, b, f.t[a].start, f.t[b - 1].end))
            continue
        info = exported.get(name) if name else None
        if not (direct or info):
            continue
        kind = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "type"}[word]
        if word == "function":
            k = j
            while k < end and not f.is_(k, "("):
                k += 1
            close = f.match.get(k, k)
            body = close + 1
            while body < end and not (f.is_(body, "{") and f.match.get(body, body) + 1 == end):
                body += 1
            returns = f.text[f.t[close].end : f.t[body].start] if body < end else ""
            if not (name or "").startswith("use") and (any(x in returns for x in ("JSX.Element", "ReactElement", "React.ReactNode")) or _has_jsx(f, body, end)):
                kind = "component"
        label = info["names"][0] if info and info["names"] else name or "default"
        meta = described(i, kind, j, end, f.t[i].start, f.t[min(end, n) - 1].end)
        if default and name:
            meta["namedDefault"] = True
        if name and label != name:
            meta["originalName"] = name
        if word == "enum":
            k = j
            while k < end and not f.is_(k, "{"):
                k += 1
            members, a = [], k + 1
            while a < end - 1:
                members.append(_unquoted(f.t[a]) if f.t[a].kind == "str" else f.t[a].text)
                while a < end - 1 and not (f.is_(a, ",") and f.depth[a] == f.depth[k] + 1):
                    a += 1
                a += 1
            meta["enumMembers"] = members
        types = (["default"] if default else ["named"] if direct else []) + (info["types"] if info else [])
        if len(types) > 1:
            meta["exports"] = types
        add(label, meta)
    for names, again in lists:
        for a, b in names:
            if again or b not in exported:
                add(a, {"originalName": b if a != b else None})
    inside = sorted(skip)
    starts = [a for a, _ in inside]
    for i, t in enumerate(f.t):
        if t.kind == "id" and t.text == "import" and f.is_(i + 1, "(") and not f.is_(i - 1, "."):
            k = bisect.bisect_right(starts, i) - 1
            if k >= 0 and inside[k][1] > i or f.is_(i + 2, ")"):
                continue
            arg = f.t[i + 2] if i + 2 < n else None
            literal = arg is not None and arg.kind == "str" and f.is_(i + 3, ")", ",")
            out.imports.append(Import(_unquoted(arg) if literal else "__dynamic__", f.line(t.start), "dynamic", "dynamic", "value"))
    out.imports.sort(key=lambda x: x.line)
    return out

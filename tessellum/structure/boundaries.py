"""Where the declarations of a source begin and end, for splitting it into chunks.

pieces() gives (is a declaration, text) in order.  Declarations keep their text; of all else
only the tokens and comments remain, run together.  None means that the language is unknown
or the source can't be read; chunks are then made by lines.  JavaScript and TypeScript are
read by the parser, Python by its own, Rust and Go by scanning brackets and keywords.
"""

from __future__ import annotations

import ast
import re

from tessellum.structure.syntax import EXTENSIONS, Node, SyntaxProblem, parse

Pieces = list[tuple[bool, str]]
_TOKENS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[^\s"'`/]+|\S""", re.S)
_WHOLE = frozenset("Class Interface Alias Enum ExportNamed ExportDefault ExportAll ExportValue Variables Import Expression Namespace".split())


def _tokens(text: str) -> Pieces:
    return [(False, m.group()) for m in _TOKENS.finditer(text)]


def _script(source: str, ext: str) -> Pieces:
    out: Pieces = []
    text = source.removeprefix(chr(0xFEFF))

    def whole(node: Node) -> bool:
        if node.kind == "Function":
            return node.form == "Declaration" and not node.generator
        return node.kind in _WHOLE

    def give(node: Node, deeper: bool) -> None:
        if whole(node):
            out.append((True, text[node.start : node.end]))
            return
        at = node.start
        for child in (x for x in node.__dict__.get("body") or [] if isinstance(x, Node)) if deeper and isinstance(node.__dict__.get("body"), list) and node.kind in ("If", "While", "For", "Do", "Labelled", "Declare") else ():
            if whole(child):
                out.extend(_tokens(text[at : child.start]))
                out.append((True, text[child.start : child.end]))
                at = child.end
        out.extend(_tokens(text[at : node.end]))

    at = 0
    for node in parse(text, ext).body:
        out.extend(_tokens(text[at : node.start]))
        give(node, True)
        at = node.end
    return out + _tokens(text[at:])


_PY_WHOLE = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign)
_PY_TOKENS = re.compile(r'''\#[^\n]*|(?:[rbfuRBFU]{0,3})(?:""".*?"""|\'\'\'.*?\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|\w+|\S''', re.S)


def _python(source: str) -> Pieces:
    raw = source.encode()
    starts = [0]
    for line in raw.splitlines(keepends=True) if b"\f" not in raw and b"\v" not in raw else re.findall(rb"[^\n]*\n|[^\n]+", raw):
        starts.append(starts[-1] + len(line))

    def loose(a: int, b: int) -> Pieces:
        return [(False, m.group()) for m in _PY_TOKENS.finditer(raw[a:b].decode())]

    out, at = [], 0
    for node in ast.parse(source).body:
        marks = getattr(node, "decorator_list", [])
        first = min([node.lineno, *[d.lineno for d in marks]])
        start = starts[first - 1] + (node.col_offset if not marks else 0)
        end = starts[node.end_lineno - 1] + node.end_col_offset
        out.extend(loose(at, start))
        future = isinstance(node, ast.ImportFrom) and node.module == "__future__"
        if isinstance(node, _PY_WHOLE) and not future:
            out.append((True, raw[start:end].decode()))
        else:
            out.extend(loose(start, end))
        at = end
    return out + loose(at, len(raw))


_BRACES = re.compile(
    r"""//[^\n]*|/\*.*?\*/|b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{?[0-9a-fA-F]+\}?|.))'|`[^`]*`|[^\W\d]\w*|\d[\w.]*|\s+|.""", re.S
)


class _Scan:
    """Tokens of a bracketed language: text, start, end, depth of brackets before it."""

    def __init__(self, source: str) -> None:
        self.source, self.items, depth = source, [], 0
        for m in _BRACES.finditer(source):
            t = m.group()
            if t.isspace():
                continue
            if t in ("}", ")", "]"):
                depth -= 1
            self.items.append((t, m.start(), m.end(), depth))
            if t in ("{", "(", "["):
                depth += 1
        if depth != 0:
            raise SyntaxProblem("brackets without a partner")

    def loose(self, a: int, b: int) -> Pieces:
        return [(False, t) for t, *_ in self.items[a:b]]

    def text(self, a: int, b: int) -> str:
        return self.source[self.items[a][1] : self.items[b - 1][2]]


def _comment(t: str) -> bool:
    return t.startswith(("//", "/*"))


_RUST = frozenset("impl struct enum trait mod use const static type".split())


def _rust(source: str) -> Pieces:
    scan, out, i = _Scan(source), [], 0
    items = scan.items
    n = len(items)

    def word(k: int) -> str:
        return items[k][0] if k < n else ""

    while i < n:
        if _comment(word(i)):
            out.append((False, word(i)))
            i += 1
            continue
        start = i
        if word(i) == "#":
            while i < n and word(i) != "]" or items[i][3] > 0:
                i += 1
            i += 1
            out.extend(scan.loose(start, i))
            continue
        k = i
        while word(k) in ("pub", "default", "async", "unsafe") or (word(k) == "const" and word(k + 1) in ("fn", "async", "unsafe", "extern")) or (word(k) == "extern" and word(k + 1) != "crate"):
            k += 1
            if word(k) == "(" and word(k - 1) == "pub":
                while items[k][0] != ")" or items[k][3] > 0:
                    k += 1
                k += 1
            elif word(k).startswith('"'):
                k += 1
        kind = word(k)
        by_semicolon = kind in ("use", "const", "static", "type")
        i = k
        while i < n and items[i][3] >= 0:
            t, depth = items[i][0], items[i][3]
            i += 1
            if depth == 0 and (t == ";" or (t == "}" and not by_semicolon)):
                break
        if kind == "macro_rules" and word(i) == ";":
            i += 1
        whole = kind in _RUST or kind == "macro_rules" or (kind == "fn" and word(i - 1) == "}")
        out.extend([(True, scan.text(start, i))] if whole else scan.loose(start, i))
    return out


def _go(source: str) -> Pieces:
    scan, out, i = _Scan(source), [], 0
    items = scan.items
    while i < len(items):
        if _comment(items[i][0]):
            out.append((False, items[i][0]))
            i += 1
            continue
        start, kind = i, items[i][0]
        while i < len(items):
            t, _, end, depth = items[i]
            i += 1
            if depth == 0 and t == ";":
                break
            ends = t in (")", "]", "}") or t[-1:].isalnum() or t[-1:] in "_\"'`"
            if depth == 0 and ends and (i == len(items) or "\n" in source[end : items[i][1]] or items[i][0].startswith("//")):
                break
        if kind in ("func", "type", "import", "var", "const"):
            out.append((True, scan.text(start, i)))
        else:
            out.extend(scan.loose(start, i))
        if i < len(items) or source.endswith("\n"):
            out.append((False, "\n"))  # the line's end is a token of this language
    return out


def pieces(source: str, ext: str) -> Pieces | None:
    try:
        if ext in EXTENSIONS:
            return _script(source, ext)
        if ext == "py":
            return _python(source)
        if ext == "rs":
            return _rust(source)
        if ext == "go":
            return _go(source)
    except (SyntaxProblem, SyntaxError, ValueError, RecursionError, MemoryError, IndexError):
        return None
    return None

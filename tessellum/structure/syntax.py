"""A reader of JavaScript, TypeScript and JSX that keeps what extraction and scopes need.

It gives a tree of Nodes: statements, functions, classes, patterns, identifiers.  Operators
and precedence are not kept, as nothing asks for them; an expression is the list of its
parts.  Types are read for the names that they use.  Unsupported(…) for an unknown
extension; SyntaxProblem where the text is not a program.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

EXTENSIONS = {"ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "jsx", "jsx": "jsx", "mjs": "jsx", "cjs": "jsx"}


class SyntaxProblem(ValueError):
    pass


class Unsupported(ValueError):
    pass


class Node:
    """kind, start, end and whatever the kind has."""

    def __init__(self, kind: str, start: int, end: int = 0, **rest: Any) -> None:
        self.kind, self.start, self.end = kind, start, end
        self.__dict__.update(rest)

    def children(self) -> list[Node]:
        out = []
        for key, v in self.__dict__.items():
            if (kind := type(v)) is Node:
                if key != "owner":
                    out.append(v)
            elif kind is list and key != "owner":
                out.extend([x for x in v if type(x) is Node])
        return out

    def __repr__(self) -> str:
        return f"{self.kind}[{self.start}:{self.end}]"


_SPACE = r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/|<!--[^\n]*)+"
_NAME = r"#?(?:[^\W\d]|[$]|\\u\{?[0-9A-Fa-f]+\}?)(?:\w|[$\u200c\u200d]|\\u\{?[0-9A-Fa-f]+\}?)*"
_NUMBER = r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
_STRING = r'"(?:[^"\\\n]|\\(?:\r\n|.))*"|' + r"'(?:[^'\\\n]|\\(?:\r\n|.))*'"
_SIGN = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#`]"
#: Blanks and comments, then a token, all in one match; nothing of the blanks is ever given back to be read as a token.
_TOKEN = re.compile(f"((?>{_SPACE})?+)(?:({_NAME})|({_NUMBER})|({_STRING})|({_SIGN}))?", re.S)
_KIND = (None, None, "name", "number", "string", "sign")
_BREAK = re.compile(r"[\n\r\u2028\u2029]")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_JSX_NAME = re.compile(r"[\w$][\w$-]*")
_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_BINARY = frozenset("== != === !== < > <= >= << + - * / % ** & | ^ && || ?? in instanceof as satisfies".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = frozenset("public private protected static readonly abstract override declare accessor async".split())


class Parser:
    def __init__(self, source: str, dialect: str) -> None:
        self.s, self.ts, self.jsx = source, dialect in ("ts", "tsx"), dialect in ("jsx", "tsx")
        self.comments: list[tuple[int, int]] = []
        self.end_before = 0
        self.no_arrow: set[tuple[int, bool]] = set()
        self.i = re.match(r"#![^\n]*", source).end() if source.startswith("#!") else 0
        self.advance()

    # tokens: kind is name, number, string, sign or end

    def advance(self) -> None:
        self.end_before = getattr(self, "end", self.i)
        m = _TOKEN.match(self.s, self.i)
        blank, k = m.group(1), m.lastindex
        self.start = m.end(1)
        self.line_break = bool(blank) and blank != " " and _BREAK.search(blank) is not None
        if k > 1:
            self.kind, self.text, self.i = _KIND[k], m.group(k), m.end()
            self.end = self.i
        elif self.start >= len(self.s):
            self.kind, self.text, self.end = "end", "", len(self.s)
            self.start = min(self.start, len(self.s))
            self.i = self.end
        else:
            raise self.problem("a string without end" if self.s[self.start] in "\"'" else f"unexpected {self.s[self.start]!r}")

    def problem(self, what: str) -> SyntaxProblem:
        return SyntaxProblem(f"{what} at {self.start}")

    def save(self) -> tuple:
        return self.i, self.kind, self.text, self.start, self.end, self.line_break, self.end_before

    def restore(self, at: tuple) -> None:
        self.i, self.kind, self.text, self.start, self.end, self.line_break, self.end_before = at

    def at(self, *texts: str) -> bool:
        return self.text in texts and self.kind in ("sign", "name")

    def take(self, text: str) -> bool:
        if self.text == text and self.kind in ("sign", "name"):
            self.advance()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.problem(f"{text!r} expected, not {self.text!r}")

    def split(self, n: int = 1) -> None:
        """Cuts the sign after n characters, as in the >> of nested type arguments."""
        self.text, self.end = self.text[:n], self.start + n
        self.i = self.end

    def close_angle(self) -> None:
        if self.kind == "sign" and self.text.startswith(">"):
            self.split()
        self.need(">")

    def attempt(self, f: Callable[[], Node | None]) -> Node | None:
        at = self.save()
        try:
            out = f()
        except SyntaxProblem:
            out = None
        if out is None:
            self.restore(at)
        return out

    def peek(self) -> tuple[str, str, bool]:
        at = self.save()
        try:
            self.advance()
            return self.kind, self.text, self.line_break
        except SyntaxProblem:
            return "bad", "", False
        finally:
            self.restore(at)

    def done(self, node: Node) -> Node:
        node.end = self.end_before
        return node

    def semicolon(self) -> None:
        if self.take(";") or self.line_break or self.at("}") or self.kind == "end":
            return
        raise self.problem(f"unexpected {self.text!r}")

    def ident(self) -> Node:
        if self.kind != "name" or self.text in _WORDS or self.text.startswith("#"):
            raise self.problem(f"a name expected, not {self.text!r}")
        node = Node("Name", self.start, self.end, name=self.text)
        self.advance()
        return node

    # statements

    def program(self) -> Node:
        node, body = Node("Program", 0), []
        while self.kind != "end":
            body.append(self.statement())
        node.body, node.end = body, len(self.s)
        return node

    def block(self) -> Node:
        node, body = Node("Block", self.start), []
        self.need("{")
        while not self.at("}"):
            if self.kind == "end":
                raise self.problem("'}' expected")
            body.append(self.statement())
        self.advance()
        node.body = body
        return self.done(node)

    def statement(self) -> Node:
        start = self.start
        node = self._statement()
        node.start = start
        return self.done(node)

    def _statement(self) -> Node:
        t, start = self.text, self.start
        if self.kind == "sign":
            if t == "{":
                return self.block()
            if t == ";":
                self.advance()
                return Node("Empty", start)
            if t == "@":
                marks = self.decorators()
                node = self.statement()
                node.decorators = marks
                return node
        elif self.kind == "name":
            f = getattr(self, f"s_{t}", None)
            if f is not None:
                if (node := f()) is not None:
                    return node
            elif t not in _WORDS and self.peek()[1] == ":":
                self.advance()
                self.advance()
                return Node("Labelled", start, body=[self.statement()])
        body = self.expression()
        self.semicolon()
        return Node("Expression", start, body=[body])

    def s_var(self) -> Node:
        node = self.variables(self.text)
        self.semicolon()
        return node

    def s_const(self) -> Node | None:
        if self.ts and self.peek()[1] == "enum":
            self.advance()
            return self.s_enum()
        return self.s_var()

    def s_let(self) -> Node | None:
        kind, text, _ = self.peek()
        if (kind == "name" and text not in ("in", "instanceof", "of")) or text in ("[", "{") or (kind == "name" and text == "of"):
            return self.s_var()
        return None

    def s_using(self) -> Node | None:
        kind, text, broken = self.peek()
        return self.variables("const", end=True) if kind == "name" and not broken and text not in ("in", "of", "instanceof") else None

    def variables(self, word: str, no_in: bool = False, end: bool = False) -> Node:
        node, items = Node("Variables", self.start, word=word), []
        self.advance()
        while True:
            one = Node("Variable", self.start, word=word, init=None, type=None)
            one.target = self.pattern()
            self.take("!")
            if self.take(":"):
                one.type = self.type()
            if self.take("="):
                one.init = self.assignment(no_in)
            items.append(self.done(one))
            if not self.take(","):
                break
        node.items = items
        if end:
            self.semicolon()
        return self.done(node)

    def s_function(self) -> Node:
        return self.function("Declaration")

    def s_async(self) -> Node | None:
        kind, text, broken = self.peek()
        return self.function("Declaration") if text == "function" and not broken else None

    def function(self, form: str) -> Node:
        node = Node("Function", self.start, form=form, name=None)
        node.is_async = self.take("async")
        self.need("function")
        node.generator = self.take("*")
        if self.kind == "name" and not self.at("("):
            node.name = self.ident()
        return self.signature_and_body(node)

    def signature_and_body(self, node: Node, arrow_free: bool = True) -> Node:
        node.type_params = self.type_params()
        node.params = self.params()
        node.returns = self.return_type() if self.take(":") else None
        if self.at("{"):
            node.body = self.block()
        else:
            node.body, node.form = None, "Declared"
            self.semicolon()
        return self.done(node)

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            p = Node("Param", self.start, decorators=self.decorators(), init=None, type=None)
            while self.ts and self.kind == "name" and self.text in _MODIFIERS and self.peek()[0] in ("name", "sign") and self.peek()[1] not in (",", ")", ":", "=", "?"):
                self.advance()
            p.rest = self.take("...")
            if self.at("this"):
                self.advance()
                p.target = Node("Nothing", self.start, self.start)
            else:
                p.target = self.pattern()
            self.take("?")
            if self.take(":"):
                p.type = self.type()
            if self.take("="):
                p.init = self.assignment()
            out.append(self.done(p))
            if not self.at(")"):
                self.need(",")
        return out

    def pattern(self) -> Node:
        node = Node("Pattern", self.start, form="array" if self.at("[") else "object", items=[])
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                node.items.append(self.with_default())
                if not self.at("]"):
                    self.need(",")
            return self.done(node)
        if self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    node.items.append(self.pattern())
                elif self.kind == "name" and self.peek()[1] in (",", "}", "="):
                    node.items.append(self.with_default())
                else:
                    if (key := self.property_name())[1] is not None:
                        node.items.append(key[1])
                    self.need(":")
                    node.items.append(self.with_default())
                if not self.at("}"):
                    self.need(",")
            return self.done(node)
        return self.ident()

    def with_default(self) -> Node:
        target = self.pattern()
        if self.take("="):
            return self.done(Node("Default", target.start, target=target, init=self.assignment()))
        return target

    def property_name(self) -> tuple[str | None, Node | None]:
        """The static name, or the computed key."""
        if self.take("["):
            key = self.assignment()
            self.need("]")
            only = key.parts[0] if key.kind == "Parts" and len(key.parts) == 1 else key
            return (only.value if only.kind == "String" else None), key
        if self.kind not in ("name", "string", "number"):
            raise self.problem(f"a property expected, not {self.text!r}")
        name = self.text[1:-1] if self.kind == "string" else self.text.lstrip("#")
        self.advance()
        return name, None

    def s_class(self) -> Node:
        return self.klass("Declaration")

    def s_abstract(self) -> Node | None:
        if self.ts and self.peek()[1] == "class":
            self.advance()
            return self.s_class()
        return None

    def klass(self, form: str) -> Node:
        node = Node("Class", self.start, form=form, name=None, parent=None)
        self.need("class")
        if self.kind == "name" and self.text not in ("extends", "implements"):
            node.name = self.ident()
        elif self.at("implements") and self.peek()[1] in ("{", "<"):
            node.name = self.ident()
        node.type_params = self.type_params()
        if self.take("extends"):
            node.parent = self.postfix(self.primary(), no_call=False)
            node.parent_types = self.type_args() if self.at("<") else []
        if self.take("implements"):
            node.implements = self.type_list()
        node.members = []
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                node.members.append(self.member())
        return self.done(node)

    def member(self) -> Node:
        node = Node("Member", self.start, decorators=self.decorators(), is_async=False, generator=False, form="field", init=None, type=None)
        if self.at("static") and self.peek()[1] == "{":
            self.advance()
            node.form, node.init = "static", self.block()
            return self.done(node)

        def modifier() -> bool:
            kind, text, broken = self.peek()
            return text not in ("(", "=", ";", ":", "?", "!", "}", "<", ",") and not (broken and self.text in ("async", "get", "set", "accessor")) and kind != "end"

        while self.kind == "name" and self.text in _MODIFIERS and modifier():
            node.is_async |= self.text == "async"
            self.advance()
        if self.take("*"):
            node.generator = True
        access = None
        if self.at("get", "set") and modifier():
            access = self.text
            self.advance()
        if self.ts and self.at("[") and (sign := self.attempt(self.index_signature)) is not None:
            return sign
        node.name, node.key = self.property_name()
        node.quoted = False
        while self.at("?", "!"):
            self.advance()
        if self.at("(", "<"):
            node.form = {"get": "get", "set": "set"}.get(access or "", "ctor" if node.name == "constructor" and node.key is None else "method")
            inner = Node("Function", self.start, form="Method", name=None, is_async=node.is_async, generator=node.generator)
            node.value = self.signature_and_body(inner)
            return self.done(node)
        if self.take(":"):
            node.type = self.type()
        if self.take("="):
            node.init = self.assignment()
        self.semicolon()
        return self.done(node)

    def index_signature(self) -> Node | None:
        node = Node("Member", self.start, form="index", decorators=[])
        self.need("[")
        self.ident()
        self.need(":")
        self.type()
        self.need("]")
        if self.take(":"):
            node.type = self.type()
        self.semicolon()
        return self.done(node)

    def decorators(self) -> list[Node]:
        out = []
        while self.take("@"):
            out.append(self.postfix(self.primary(), no_call=False))
        return out

    def s_import(self) -> Node | None:
        start = self.start
        if self.peek()[1] in ("(", "."):
            return None
        self.advance()
        node = Node("Import", start, names=[], type_only=False)
        if self.kind == "string":
            self.advance()
        else:
            if self.at("type") and (self.peek()[1] in ("{", "*") or (self.peek()[0] == "name" and self.peek()[1] != "from")):
                self.advance()
                node.type_only = True
            if self.kind == "name":
                node.names.append(self.ident())
                if self.take("="):
                    node.init = self.expression()
                    self.semicolon()
                    return node
                self.take(",")
            if self.take("*"):
                self.need("as")
                node.names.append(self.ident())
            elif self.take("{"):
                while not self.take("}"):
                    only_type = self.at("type") and self.peek()[1] not in (",", "}", "as") and self.peek()[0] in ("name", "string")
                    if only_type:
                        self.advance()
                    name = Node("Name", self.start, self.end, name=self.text)
                    self.advance()
                    if self.take("as"):
                        name = self.ident()
                    name.type_only = only_type
                    node.names.append(name)
                    if not self.at("}"):
                        self.need(",")
            self.need("from")
            self.advance()
        if self.at("with", "assert") and not self.line_break:
            self.advance()
            self.primary()
        self.semicolon()
        return node

    def s_export(self) -> Node:
        start = self.start
        self.advance()
        if self.take("default"):
            node = Node("ExportDefault", start)
            if self.at("function") or (self.at("async") and self.peek()[1] == "function" and not self.peek()[2]):
                node.declaration = self.function("Declaration")
            elif self.at("class", "@") or (self.at("abstract") and self.peek()[1] == "class"):
                marks = self.decorators()
                self.take("abstract")
                node.declaration = self.klass("Declaration")
                node.declaration.decorators = marks
            elif self.ts and self.at("interface") and self.peek()[0] == "name":
                node.declaration = self.statement()
            else:
                node.declaration = self.assignment()
                self.semicolon()
            return node
        if self.take("*"):
            node = Node("ExportAll", start)
            if self.take("as"):
                self.advance()
            self.need("from")
            self.advance()
            self.semicolon()
            return node
        if self.take("="):
            node = Node("ExportValue", start, body=[self.expression()])
            self.semicolon()
            return node
        node = Node("ExportNamed", start, specifiers=[], declaration=None, source=False)
        if self.at("as") and self.peek()[1] == "namespace":
            self.advance()
            self.advance()
            self.advance()
            self.semicolon()
            return node
        if self.at("type") and self.peek()[1] in ("{", "*"):
            self.advance()
            if self.take("*"):
                if self.take("as"):
                    self.advance()
                self.need("from")
                self.advance()
                self.semicolon()
                return Node("ExportAll", start)
        if self.take("{"):
            while not self.take("}"):
                if self.at("type") and self.peek()[1] not in (",", "}", "as"):
                    self.advance()
                name = self.text[1:-1] if self.kind == "string" else self.text
                node.specifiers.append(Node("Name", self.start, self.end, name=name))
                self.advance()
                if self.take("as"):
                    self.advance()
                if not self.at("}"):
                    self.need(",")
            if self.take("from"):
                node.source = True
                self.advance()
            self.semicolon()
            return node
        if self.at("import"):
            return self.s_import()
        node.declaration = self.statement()
        if node.declaration.kind in ("Expression", "Empty"):
            raise self.problem("a declaration expected")
        return node

    def s_if(self) -> Node:
        node = Node("If", self.start)
        self.advance()
        node.test, node.body = self.parenthesised(), [self.statement()]
        if self.take("else"):
            node.body.append(self.statement())
        return node

    def parenthesised(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def s_while(self) -> Node:
        node = Node("While", self.start)
        self.advance()
        node.test, node.body = self.parenthesised(), [self.statement()]
        return node

    s_with = s_while

    def s_do(self) -> Node:
        node = Node("Do", self.start)
        self.advance()
        node.body = [self.statement()]
        self.need("while")
        node.test = self.parenthesised()
        self.take(";")
        return node

    def s_for(self) -> Node:
        node = Node("For", self.start, head=[])
        self.advance()
        self.take("await")
        self.need("(")
        if not self.at(";"):
            declares = self.at("var", "const") or (self.at("let") and (self.peek()[0] == "name" or self.peek()[1] in ("[", "{"))) or (self.at("using") and self.peek()[0] == "name" and self.peek()[1] != "of")
            node.head.append(self.variables(self.text, no_in=True) if declares else self.expression(no_in=True))
        if self.at("of", "in"):
            self.advance()
            node.head.append(self.expression())
        else:
            self.need(";")
            if not self.at(";"):
                node.head.append(self.expression())
            self.need(";")
            if not self.at(")"):
                node.head.append(self.expression())
        self.need(")")
        node.body = [self.statement()]
        return node

    def s_return(self) -> Node:
        node = Node("Return", self.start, body=[])
        self.advance()
        if not (self.at(";", "}") or self.line_break or self.kind == "end"):
            node.body.append(self.expression())
        self.semicolon()
        return node

    s_throw = s_return

    def s_break(self) -> Node:
        node = Node("Break", self.start)
        self.advance()
        if self.kind == "name" and not self.line_break:
            self.advance()
        self.semicolon()
        return node

    s_continue = s_debugger = s_break

    def s_switch(self) -> Node:
        node = Node("Switch", self.start)
        self.advance()
        node.test, node.body = self.parenthesised(), []
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                node.body.append(self.expression())
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                node.body.append(self.statement())
        return node

    def s_try(self) -> Node:
        node = Node("Try", self.start, handler=None, last=None)
        self.advance()
        node.body = [self.block()]
        if self.at("catch"):
            node.handler = Node("Catch", self.start, param=None)
            self.advance()
            if self.take("("):
                node.handler.param = self.pattern()
                if self.take(":"):
                    self.type()
                self.need(")")
            node.handler.body = self.block()
            self.done(node.handler)
        if self.take("finally"):
            node.last = self.block()
        elif node.handler is None:
            raise self.problem("'catch' or 'finally' expected")
        return node

    def s_enum(self) -> Node | None:
        if not self.ts:
            return None
        node = Node("Enum", self.start, items=[])
        self.advance()
        node.name = self.ident()
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                node.items.append(self.assignment())
            if not self.at("}"):
                self.need(",")
        return node

    def s_interface(self) -> Node | None:
        if not self.ts or self.peek()[0] != "name" or self.peek()[2]:
            return None
        node = Node("Interface", self.start, bases=[])
        self.advance()
        node.name = self.ident()
        node.type_params = self.type_params()
        if self.take("extends"):
            node.bases = self.type_list()
        node.type = self.type_body()
        return node

    def s_type(self) -> Node | None:
        if not self.ts or self.peek()[0] != "name" or self.peek()[2]:
            return None
        node = Node("Alias", self.start)
        self.advance()
        node.name = self.ident()
        node.type_params = self.type_params()
        self.need("=")
        node.type = self.type()
        self.semicolon()
        return node

    def s_declare(self) -> Node | None:
        kind, text, broken = self.peek()
        if not self.ts or kind != "name" or broken or text in ("in", "instanceof", "as"):
            return None
        node = Node("Declare", self.start)
        self.advance()
        if self.at("global"):
            self.advance()
            node.body = [self.block()]
            return node
        node.body = [self.statement()]
        return node

    def s_namespace(self) -> Node | None:
        kind, _, broken = self.peek()
        if not self.ts or kind not in ("name", "string") or broken:
            return None
        node = Node("Namespace", self.start)
        self.advance()
        node.name = None
        if self.kind == "string":
            self.advance()
        else:
            node.name = self.ident()
            while self.take("."):
                self.ident()
        if self.at("{"):
            node.body = [self.block()]
        else:
            node.body = []
            self.semicolon()
        return node

    s_module = s_namespace

    # expressions

    def expression(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        if not self.at(","):
            return first
        node = Node("Parts", first.start, parts=[first])
        while self.take(","):
            node.parts.append(self.assignment(no_in))
        return self.done(node)

    def assignment(self, no_in: bool = False, in_branch: bool = False) -> Node:
        start = self.start
        if (arrow := self.arrow(in_branch)) is not None:
            return arrow
        if self.at("yield") and self.peek()[1] not in ("=", ".", "=>", ":", "("):
            node = Node("Parts", start, parts=[])
            self.advance()
            starred = self.take("*")
            if starred or not (self.line_break or self.at(")", "]", "}", ",", ";", ":") or self.kind == "end"):
                node.parts.append(self.assignment(no_in))
            return self.done(node)
        node = Node("Parts", start, parts=[self.unary()])
        while True:
            if self.kind == "sign" and self.text == ">":  # > is read one by one
                rest = self.s[self.start :]
                op = next((x for x in (">>>=", ">>=", ">>>", ">=", ">>", ">") if rest.startswith(x)), ">")
                if op != ">":
                    self.text, self.end = op, self.start + len(op)
                    self.i = self.end
            t = self.text
            if self.kind == "end" or self.kind in ("string", "number"):
                break
            if t in _ASSIGN and self.kind == "sign":
                self.advance()
                node.parts.append(self.assignment(no_in, in_branch))
                break
            if t == "?":
                self.advance()
                node.parts.append(self.assignment(False, True))
                self.need(":")
                node.parts.append(self.assignment(no_in, in_branch))
                break
            if t in ("as", "satisfies") and self.kind == "name":
                if not self.ts or self.line_break:
                    break
                self.advance()
                if not self.take("const"):
                    node.parts.append(self.type())
                continue
            if not (t in _BINARY or t in (">>", ">>>")) or (t == "in" and no_in):
                break
            self.advance()
            node.parts.append(self.unary())
        if len(node.parts) == 1:
            return node.parts[0]
        return self.done(node)

    def arrow(self, in_branch: bool = False) -> Node | None:
        """An arrow function, or nothing."""
        key = (self.start, in_branch)
        if key in self.no_arrow:
            return None
        if not (self.at("(", "<") or (self.kind == "name" and self.text not in _WORDS)):
            return None
        if self.kind == "name" and self.text != "async":
            if self.peek()[1] != "=>":
                return None
        elif self.at("async"):
            kind, text, broken = self.peek()
            if broken or not (kind == "name" or text in ("(", "<", "=>")):
                return None
        node = self.attempt(lambda: self._arrow_head(in_branch))
        if node is None:
            self.no_arrow.add(key)
            return None
        at = self.save() if in_branch and node.returns is not None else None
        if self.at("{"):
            node.body = self.block()
        else:
            node.body = self.assignment(in_branch=in_branch)
        if at is not None and not self.at(":"):
            self.restore(node.before)
            self.no_arrow.add(key)
            return None
        return self.done(node)

    def _arrow_head(self, in_branch: bool) -> Node | None:
        node = Node("Arrow", self.start, is_async=False, returns=None, type_params=[])
        before = self.save()
        if self.at("async") and self.peek()[1] != "=>":
            self.advance()
            node.is_async = True
        if self.kind == "name":
            node.params = [Node("Param", self.start, self.end, target=self.ident(), init=None, type=None)]
        else:
            if self.at("<"):
                if self.jsx and not self.ts:
                    return None
                node.type_params = self.type_params()
                if self.jsx and not (len(node.type_params) > 1 or self.s[node.start : self.start].rstrip().endswith(",>") or "extends" in self.s[node.start : self.start]):
                    return None
            if not self.at("("):
                return None
            node.params = self.params()
            if self.take(":"):
                node.returns = self.return_type()
        if not self.at("=>") or self.line_break:
            return None
        self.advance()
        node.before = before
        return node

    def unary(self) -> Node:
        start = self.start
        if self.kind == "sign" and self.text in ("!", "~", "+", "-", "++", "--"):
            self.advance()
            return self.done(Node("Parts", start, parts=[self.unary()]))
        if self.kind == "name" and self.text in ("typeof", "void", "delete", "await"):
            if self.text != "await" or self.peek()[1] not in (")", ",", ";", "=", ".", "=>", "]", ":", "?", "}", "in"):
                self.advance()
                return self.done(Node("Parts", start, parts=[self.unary()]))
        if self.at("<") and self.ts and not self.jsx:
            self.advance()
            parts = [] if self.take("const") else [self.type()]
            self.close_angle()
            return self.done(Node("Parts", start, parts=[*parts, self.unary()]))
        node = self.postfix(self.primary())
        if self.at("++", "--") and not self.line_break:
            self.advance()
        return node

    def postfix(self, node: Node, no_call: bool = False) -> Node:
        start, parts = node.start, [node]
        while True:
            if self.kind == "sign":
                t = self.text
                if t == "." or t == "?.":
                    self.advance()
                    if t == "?." and self.at("(", "[", "<", "`"):
                        continue
                    if self.kind != "name":
                        raise self.problem(f"a property expected, not {self.text!r}")
                    self.advance()
                    continue
                if t == "[":
                    self.advance()
                    parts.append(self.expression())
                    self.need("]")
                    continue
                if t == "(" and not no_call:
                    parts.extend(self.arguments())
                    continue
                if t == "`":
                    parts.append(self.template())
                    continue
                if t == "!" and self.ts and not self.line_break:
                    self.advance()
                    continue
                if t in ("<", "<<") and self.ts:
                    if t == "<<":
                        break
                    types = self.attempt(self._call_types)
                    if types is not None:
                        parts.append(types)
                        continue
            break
        return node if len(parts) == 1 and self.end_before == node.end else self.done(Node("Parts", start, parts=parts))

    def _call_types(self) -> Node | None:
        node = Node("Parts", self.start, parts=self.type_args())
        if self.at("(", "`") or self.at(")", "]", ",", ";", ":", "}", ".", "?.", "===", "!==", "==", "!=", "&&", "||", "??", "?", "{") or self.kind == "end" or self.line_break:
            return self.done(node)
        return None

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            self.take("...")
            out.append(self.assignment())
            if not self.at(")"):
                self.need(",")
        return out

    def primary(self) -> Node:
        start, t = self.start, self.text
        if self.kind == "name":
            if t == "function" or (t == "async" and self.peek()[1] == "function" and not self.peek()[2]):
                return self.function("Expression")
            if t == "class":
                return self.klass("Expression")
            if t == "new":
                self.advance()
                if self.take("."):
                    self.advance()
                    return self.done(Node("Parts", start, parts=[]))
                parts = [self.postfix(self.primary(), no_call=True)]
                if self.at("("):
                    parts.extend(self.arguments())
                return self.done(Node("Parts", start, parts=parts))
            if t in ("this", "super", "null", "true", "false"):
                self.advance()
                return self.done(Node("Word", start))
            if t == "import":
                self.advance()
                if not self.at("(", "."):
                    raise self.problem("unexpected import")
                return self.done(Node("Word", start))
            if t.startswith("#"):
                self.advance()
                return self.done(Node("Word", start))
            return self.ident()
        if self.kind == "number":
            self.advance()
            return self.done(Node("Word", start))
        if self.kind == "string":
            node = Node("String", start, self.end, value=t[1:-1])
            self.advance()
            return node
        if t == "(":
            self.advance()
            inner = self.expression()
            self.need(")")
            return self.done(Node("Parts", start, parts=[inner]))
        if t == "[":
            self.advance()
            node = Node("Parts", start, parts=[])
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                node.parts.append(self.assignment())
                if not self.at("]"):
                    self.need(",")
            return self.done(node)
        if t == "{":
            return self.object()
        if t == "`":
            return self.template()
        if t in ("/", "/="):
            if (m := _REGEX.match(self.s, start)) is None:
                raise self.problem("a regular expression without end")
            self.i = self.end = m.end()
            self.advance()
            return self.done(Node("Word", start))
        if t == "<" and self.jsx:
            return self.element()
        if t == "@":
            self.decorators()
            return self.klass("Expression")
        raise self.problem(f"unexpected {t!r}")

    def template(self) -> Node:
        node, s, at = Node("Parts", self.start, parts=[]), self.s, self.start + 1
        while True:
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(s, at)
            at = m.end()
            if at >= len(s):
                raise self.problem("a template without end")
            if s[at] == "`":
                self.i = self.end = at + 1
                self.advance()
                return self.done(node)
            self.i = self.end = at + 2
            self.advance()
            node.parts.append(self.expression())
            if not self.at("}"):
                raise self.problem("'}' expected")
            at = self.end

    def object(self) -> Node:
        node = Node("Object", self.start, items=[])
        self.need("{")
        while not self.take("}"):
            node.items.append(self.property())
            if not self.at("}"):
                self.need(",")
        return self.done(node)

    def property(self) -> Node:
        if self.take("..."):
            return self.assignment()
        node = Node("Property", self.start, form="value", is_async=False, generator=False, value=None, key=None)
        ends = ("(", ",", "}", ":", "=", "<")
        if self.at("async") and self.peek()[1] not in ends:
            node.is_async = True
            self.advance()
        if self.take("*"):
            node.generator = True
        if self.at("get", "set") and self.peek()[1] not in ends:
            node.form = self.text
            self.advance()
        own = Node("Name", self.start, self.end, name=self.text) if self.kind == "name" else None
        node.name, node.key = self.property_name()
        if self.at("(", "<"):
            inner = Node("Function", self.start, form="Method", name=None, is_async=node.is_async, generator=node.generator)
            node.value = self.signature_and_body(inner)
            node.form = "method" if node.form == "value" else node.form
        elif self.take(":"):
            node.value = self.assignment()
        elif own is not None:
            node.value = own
            if self.take("="):
                node.value = Node("Parts", own.start, parts=[own, self.assignment()])
        else:
            raise self.problem("':' expected")
        return self.done(node)

    def element(self) -> Node:
        """An element or fragment of JSX; the current token is <."""
        node = Node("Element", self.start, parts=[])
        self.need("<")
        name = self.element_name(node)
        while name is not None and not self.at(">", "/"):
            if self.take("{"):
                self.need("...")
                node.parts.append(self.assignment())
                self.need("}")
                continue
            if self.kind == "sign" and self.text == "<" and self.ts:
                node.parts.extend(self.type_args())
                continue
            if self.kind != "name":
                raise self.problem(f"an attribute expected, not {self.text!r}")
            self.jsx_word()
            if self.take(":"):
                self.jsx_word()
            if self.at("="):
                at = self.end
                m = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')").match(self.s, at)
                if m:
                    self.i = self.end = m.end()
                    self.advance()
                else:
                    self.advance()
                    if self.take("{"):
                        node.parts.append(self.assignment())
                        self.need("}")
                    else:
                        node.parts.append(self.element())
        if self.take("/"):
            if not self.at(">"):
                raise self.problem("'>' expected")
            self.split()
            self.advance()
            return self.done(node)
        if not (self.kind == "sign" and self.text.startswith(">")):
            raise self.problem("'>' expected")
        at = self.start + 1
        while True:
            m = re.compile(r"[^<{]*").match(self.s, at)
            self.i = self.end = m.end()
            if self.i >= len(self.s):
                raise self.problem("an element without end")
            self.advance()
            if self.at("{"):
                self.advance()
                if not self.at("}"):
                    self.take("...")
                    node.parts.append(self.expression())
                if not self.at("}"):
                    raise self.problem("'}' expected")
                at = self.end
            elif self.text == "<" and self.peek()[1] == "/":
                self.advance()
                self.advance()
                if self.element_name(node) != name:
                    raise self.problem("another closing name expected")
                if not (self.kind == "sign" and self.text.startswith(">")):
                    raise self.problem("'>' expected")
                self.split()
                self.advance()
                return self.done(node)
            elif self.text.startswith("<"):
                self.split()
                child = self.element()
                node.parts.append(child)
                at = child.end
            else:
                raise self.problem("'<' expected")

    def jsx_word(self) -> str:
        m = _JSX_NAME.match(self.s, self.start)
        if m is None:
            raise self.problem("a name expected")
        self.i = self.end = m.end()
        self.advance()
        return m.group()

    def element_name(self, node: Node) -> str | None:
        if self.kind != "name":
            return None
        start, word = self.start, self.jsx_word()
        name, parts = Node("Name", start, start + len(word), name=word), [word]
        while self.at(".", ":"):
            self.advance()
            parts.append(self.jsx_word())
        if len(parts) > 1 or word[0].isupper() or word[0] in "_$":
            node.parts.append(name)
        return ".".join(parts)

    # types: read for the names that they use

    def type_params(self) -> list[Node]:
        out = []
        if not (self.at("<") and self.ts):
            return out
        self.advance()
        while not self.at(">"):
            while self.at("const", "in", "out") and self.peek()[0] == "name":
                self.advance()
            p = Node("TypeParam", self.start)
            p.name = self.ident()
            p.types = [self.type()] if self.take("extends") else []
            if self.take("="):
                p.types.append(self.type())
            out.append(self.done(p))
            if not self.at(">"):
                self.need(",")
        self.close_angle()
        return out

    def type_args(self) -> list[Node]:
        self.need("<")
        out = []
        while not (self.kind == "sign" and self.text.startswith(">")):
            out.append(self.type())
            if not (self.kind == "sign" and self.text.startswith(">")):
                self.need(",")
        self.close_angle()
        return out

    def type_list(self) -> list[Node]:
        out = [self.type()]
        while self.take(","):
            out.append(self.type())
        return out

    def return_type(self) -> Node:
        at = self.save()
        if self.at("asserts") and self.peek()[0] == "name" and not self.peek()[2]:
            self.advance()
            if not self.at("is"):
                self.advance()
                if not self.take("is"):
                    return self.done(Node("Type", at[3], parts=[]))
                return self.type()
            self.restore(at)
        if self.kind == "name" and self.peek()[1] == "is":
            self.advance()
            self.advance()
        return self.type()

    def type(self) -> Node:
        node = Node("Type", self.start, parts=[])
        node.parts.append(self.union())
        if self.at("extends") and not self.line_break and getattr(self, "conditional", True):
            self.advance()
            old, self.conditional = getattr(self, "conditional", True), False
            node.parts.append(self.type())
            self.conditional = old
            self.need("?")
            node.parts.append(self.type())
            self.need(":")
            node.parts.append(self.type())
        return self.done(node)

    def union(self) -> Node:
        node = Node("Type", self.start, parts=[])
        while self.at("|", "&"):
            self.advance()
        node.parts.append(self.type_unit())
        while self.at("|", "&"):
            self.advance()
            node.parts.append(self.type_unit())
        return self.done(node)

    def type_unit(self) -> Node:
        start, t = self.start, self.text
        node = Node("Type", start, parts=[])
        if self.kind == "name" and t in ("keyof", "unique", "readonly", "infer") and (self.peek()[0] in ("name", "string") or self.peek()[1] in ("(", "[", "{")):
            self.advance()
            if t == "infer":
                p = Node("TypeParam", self.start, types=[])
                p.name = self.ident()
                node.parts.append(self.done(p))
                if self.at("extends"):
                    extra = self.attempt(self._infer_bound)
                    if extra is not None:
                        node.parts.append(extra)
            else:
                node.parts.append(self.type_unit())
            return self.done(node)
        if self.at("new", "abstract") and self.peek()[1] in ("(", "<", "new"):
            self.take("abstract")
            self.take("new")
            return self.function_type()
        if t == "<":
            return self.function_type()
        if t == "(":
            f = self.attempt(self.function_type)
            if f is not None:
                return f
            self.advance()
            old, self.conditional = getattr(self, "conditional", True), True
            node.parts.append(self.type())
            self.conditional = old
            self.need(")")
        elif t == "[":
            self.advance()
            while not self.take("]"):
                self.take("...")
                if self.kind == "name" and (self.peek()[1] == ":" or (self.peek()[1] == "?" and re.match(r"\s*\?\s*:", self.s[self.end :]))):
                    self.advance()
                    self.take("?")
                    self.need(":")
                node.parts.append(self.type())
                self.take("?")
                if not self.at("]"):
                    self.need(",")
        elif t == "{":
            node.parts.append(self.type_body())
        elif t == "`":
            at = self.start + 1
            while True:
                m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(self.s, at)
                at = m.end()
                if at >= len(self.s):
                    raise self.problem("a template without end")
                if self.s[at] == "`":
                    self.i = self.end = at + 1
                    self.advance()
                    break
                self.i = self.end = at + 2
                self.advance()
                node.parts.append(self.type())
                if not self.at("}"):
                    raise self.problem("'}' expected")
                at = self.end
        elif self.kind in ("string", "number"):
            self.advance()
        elif t == "-":
            self.advance()
            self.advance()
        elif t == "typeof":
            self.advance()
            if self.at("import"):
                return self.import_type(node)
            name = Node("Name", self.start, self.end, name=self.text)
            self.advance()
            if name.name != "this":
                node.parts.append(name)
            while self.take("."):
                self.advance()
            if self.at("<") and not self.line_break:
                node.parts.extend(self.type_args())
        elif t == "import":
            return self.import_type(node)
        elif self.kind == "name" and t in ("this", "void", "null", "true", "false", "undefined"):
            self.advance()
        elif self.kind == "name":
            node.parts.append(self.ident())
            while self.take("."):
                self.advance()
            if self.at("<") and not self.line_break:
                node.parts.extend(self.type_args())
        else:
            raise self.problem(f"a type expected, not {t!r}")
        while self.at("[") and not self.line_break:
            self.advance()
            if not self.at("]"):
                node.parts.append(self.type())
            self.need("]")
        return self.done(node)

    def _infer_bound(self) -> Node | None:
        self.need("extends")
        old, self.conditional = getattr(self, "conditional", True), False
        bound = self.type()
        self.conditional = old
        return None if self.at("?") and old else bound

    def import_type(self, node: Node) -> Node:
        self.advance()
        self.need("(")
        self.type()
        self.need(")")
        while self.take("."):
            self.advance()
        if self.at("<"):
            node.parts.extend(self.type_args())
        return self.done(node)

    def function_type(self) -> Node:
        node = Node("FunctionType", self.start)
        node.type_params = self.type_params()
        node.params = self.params()
        self.need("=>")
        node.returns = self.return_type()
        return self.done(node)

    def type_body(self) -> Node:
        """{ members }: signatures, mapped types."""
        node = Node("Type", self.start, parts=[])
        self.need("{")
        while not self.take("}"):
            if self.at("+", "-"):
                self.advance()
            while self.at("readonly", "get", "set", "new") and self.peek()[1] not in (":", "?", "(", "<", ";", ",", "}") or (self.at("new") and self.peek()[1] in ("(", "<")):
                self.advance()
            if self.take("["):
                if self.kind == "name" and self.peek()[1] == "in":
                    p = Node("TypeParam", self.start, types=[])
                    p.name = self.ident()
                    self.advance()
                    p.types.append(self.type())
                    if self.take("as"):
                        p.types.append(self.type())
                    node.parts.append(self.done(p))
                elif self.kind == "name" and self.peek()[1] == ":":
                    self.advance()
                    self.advance()
                    node.parts.append(self.type())
                else:
                    node.parts.append(self.assignment())
                self.need("]")
            elif not self.at("(", "<"):
                self.property_name()
            if self.at("+", "-"):
                self.advance()
            self.take("?")
            if self.at("(", "<"):
                f = Node("FunctionType", self.start)
                f.type_params = self.type_params()
                f.params = self.params()
                f.returns = self.return_type() if self.take(":") else None
                node.parts.append(self.done(f))
            elif self.take(":"):
                node.parts.append(self.type())
            if not (self.take(";") or self.take(",")) and not self.at("}") and not self.line_break:
                raise self.problem("';' expected")
        return self.done(node)


def parse(source: str, ext: str) -> Node:
    """The program's tree; ext says which dialect."""
    dialect = EXTENSIONS.get(ext.lower())
    if dialect is None:
        raise Unsupported("unsupported file type")
    try:
        return Parser(source.removeprefix("\ufeff"), dialect).program()
    except RecursionError:
        raise SyntaxProblem("nested too deep") from None

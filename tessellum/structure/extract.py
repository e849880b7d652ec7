"""Functions, bindings and exports of one JavaScript or TypeScript source.

Lines and byte columns count from 1.  Rules that readers may not expect: everything nested
in an exported declaration is exported; a function that an export list names is exported only
if the list comes first, a binding always; only an arrow that is directly the value of a plain
variable has a name; function expressions within a method are left out.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from tessellum.structure.syntax import Node, SyntaxProblem, parse

NAMED, DEFAULT = 1, 2
LABELS = {
    "fn": "FunctionDeclaration", "arr": "ArrowFunctionExpression", "fex": "FunctionExpression", "cls": "ClassMethod",
    "obj": "ObjectMethod", "get": "Getter", "set": "Setter", "ctor": "Constructor",
}
KINDS = {"top": {"fn"}, "top+arrow": {"fn", "arr"}, "top+arrow+class": {"fn", "arr", "cls", "ctor", "get", "set"}, "all": set(LABELS)}


class Lines:
    """Line and byte column of a place in a text."""

    def __init__(self, text: str) -> None:
        self.text, self.ascii = text, text.isascii()
        self.starts = [0, *accumulate(len(x) + 1 for x in text.split("\n")[:-1])]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def col(self, at: int) -> int:
        start = self.starts[bisect_right(self.starts, at) - 1]
        return 1 + (at - start if self.ascii else len(self.text[start:at].encode()))


class Reader:
    """Walks the tree in order, noting functions and exports."""

    def __init__(self, lines: Lines, kinds: set[str]) -> None:
        self.lines, self.kinds = lines, kinds
        self.functions: list[dict] = []
        self.exports: list[dict] = []
        self.names: set[str] = set()
        self.in_export = self.in_default = self.in_method = False

    def function(self, name: str | None, kind: str, node: Node, is_async: bool, generator: bool) -> None:
        if kind in self.kinds:
            self.functions.append({
                "name": name, "kind": kind, "exported": self.in_export or self.in_default or (name is not None and name in self.names),
                "is_async": is_async, "is_generator": generator,
                "line": self.lines.line(node.start), "col": self.lines.col(node.start), "line_end": self.lines.line(node.end),
            })

    def export(self, name: str, code: int) -> None:
        self.names.add(name)
        self.exports.append({"name": name, "kind_code": code})

    def walk(self, node: Node) -> None:
        getattr(self, f"on_{node.kind}", self.below)(node)

    def below(self, node: Node) -> None:
        for child in node.children():
            self.walk(child)

    def on_ExportNamed(self, node: Node) -> None:  # noqa: N802
        for s in node.specifiers:
            self.export(s.name, NAMED)
        d = node.declaration
        if d is not None:
            if d.kind == "Declare":
                d = d.body[0]
            if d.kind in ("Function", "Class", "Enum") and d.name is not None:
                self.export(d.name.name, NAMED)
            elif d.kind == "Variables":
                for v in d.items:
                    if v.target.kind == "Name":
                        self.export(v.target.name, NAMED)
        self.in_export = True
        self.below(node)
        self.in_export = False

    def on_ExportDefault(self, node: Node) -> None:  # noqa: N802
        self.export("default", DEFAULT)
        d = node.declaration
        if d.kind in ("Function", "Class") and d.form != "Expression" and d.name is not None and d.form != "Declared":
            self.export(d.name.name, DEFAULT)
        self.in_default = True
        self.below(node)
        self.in_default = False

    def on_Function(self, node: Node) -> None:  # noqa: N802
        name = node.name.name if node.name is not None else None
        if node.form == "Declaration":
            self.function(name, "fn", node, node.is_async, node.generator)
        elif node.form == "Expression" and not self.in_method:
            self.function(name, "fex", node, node.is_async, node.generator)
        self.below(node)

    def on_Arrow(self, node: Node) -> None:  # noqa: N802
        self.function(None, "arr", node, node.is_async, False)
        self.below(node)

    def on_Variable(self, node: Node) -> None:  # noqa: N802
        before = len(self.functions)
        self.below(node)
        if node.init is not None and node.init.kind == "Arrow" and node.target.kind == "Name" and len(self.functions) > before:
            first = self.functions[before]
            if first["kind"] == "arr" and first["name"] is None:
                first["name"] = node.target.name

    def on_Member(self, node: Node) -> None:  # noqa: N802
        if node.form not in ("get", "set", "ctor", "method"):
            return self.below(node)
        self.function(node.name, {"method": "cls"}.get(node.form, node.form), node, node.is_async, node.generator)
        self.in_method = True
        self.below(node)
        self.in_method = False

    def on_Property(self, node: Node) -> None:  # noqa: N802
        if node.form == "value":
            return self.below(node)
        self.function(node.name, {"method": "obj"}.get(node.form, node.form), node, node.is_async, node.generator)
        self.in_method = True
        self.below(node)
        self.in_method = False


class Scope:
    def __init__(self, above: Scope | None, function: bool = False) -> None:
        self.above, self.function, self.names = above, function or above is None, {}

    def find(self, name: str) -> dict | None:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.names:
                return scope.names[name]
            scope = scope.above
        return None


class Binder:
    """Declares all names first to last, then counts the references that reach each."""

    def __init__(self) -> None:
        self.symbols: list[dict] = []
        self.uses: list[tuple[Scope, str]] = []

    def declare(self, scope: Scope, node: Node, kind: str | None) -> None:
        if kind == "var":
            while not scope.function:
                scope = scope.above
        old = scope.names.get(node.name)
        if old is not None:  # the same name again is the same symbol
            if old["kind"] is None:
                old["kind"] = kind
            return
        scope.names[node.name] = symbol = {"name": node.name, "kind": kind, "at": node.start, "refs": 0}
        self.symbols.append(symbol)

    def pattern(self, node: Node, scope: Scope, kind: str) -> None:
        if node.kind == "Name":
            self.declare(scope, node, kind)
        elif node.kind == "Default":
            self.pattern(node.target, scope, kind)
            self.walk(node.init, scope)
        elif node.kind == "Pattern":
            for x in node.items:
                if x.kind in ("Name", "Pattern", "Default"):
                    self.pattern(x, scope, kind)
                else:
                    self.walk(x, scope)
        elif node.kind != "Nothing":
            self.walk(node, scope)

    def walk(self, node: Node, scope: Scope) -> None:
        f = getattr(self, f"on_{node.kind}", None)
        if f is not None:
            f(node, scope)
        else:
            self.below(node, scope)

    def below(self, node: Node, scope: Scope) -> None:
        for child in node.children():
            self.walk(child, scope)

    def hoist(self, body: list[Node], scope: Scope) -> None:
        """Names of functions, classes and the like hold in their whole block."""
        for node in body:
            d = node.declaration if node.kind in ("ExportNamed", "ExportDefault") else node
            if d is not None and d.kind == "Declare":
                d = d.body[0] if d.body else None
            if d is None:
                continue
            if d.kind == "Function" and d.name is not None and d.form in ("Declaration", "Declared"):
                self.declare(scope, d.name, "fn")
            elif d.kind == "Class" and d.name is not None and d.form == "Declaration":
                self.declare(scope, d.name, "class")
            elif d.kind == "Enum":
                self.declare(scope, d.name, "enum")
            elif d.kind in ("Interface", "Alias", "Namespace") and d.name is not None:
                self.declare(scope, d.name, None)
            elif d.kind == "Import":
                for n in d.names:
                    self.declare(scope, n, None if d.type_only or getattr(n, "type_only", False) else "import")
            elif d.kind == "Variables":
                for v in d.items:
                    self.pattern_names(v.target, scope, d.word)

    def pattern_names(self, node: Node, scope: Scope, kind: str) -> None:
        if node.kind == "Name":
            self.declare(scope, node, kind)
        elif node.kind == "Default":
            self.pattern_names(node.target, scope, kind)
        elif node.kind == "Pattern":
            for x in node.items:
                self.pattern_names(x, scope, kind)

    def body(self, node: Node, scope: Scope) -> None:
        self.hoist(node.body, scope)
        for x in node.body:
            self.walk(x, scope)

    def on_Program(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.body(node, scope)

    def on_Block(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.body(node, Scope(scope))

    def on_Name(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.uses.append((scope, node.name))

    def on_Import(self, node: Node, scope: Scope) -> None:  # noqa: N802
        if getattr(node, "init", None) is not None:
            self.walk(node.init, scope)

    def on_ExportNamed(self, node: Node, scope: Scope) -> None:  # noqa: N802
        if not node.source:
            for s in node.specifiers:
                self.walk(s, scope)
        if node.declaration is not None:
            self.walk(node.declaration, scope)

    def on_Variable(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.pattern(node.target, scope, node.word)
        for x in (node.type, node.init):
            if x is not None:
                self.walk(x, scope)

    def on_TypeParam(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.declare(scope, node.name, None)
        for x in node.types:
            self.walk(x, scope)

    def on_Param(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.pattern(node.target, scope, "var")
        for x in (*getattr(node, "decorators", []), node.type, node.init):
            if x is not None:
                self.walk(x, scope)

    def on_Function(self, node: Node, scope: Scope) -> None:  # noqa: N802
        inner = Scope(scope, function=True)
        if node.name is not None and node.form == "Expression":
            self.declare(inner, node.name, "fn")
        elif node.name is not None:
            self.declare(scope, node.name, "fn")
        if node.form == "Declared":  # parameters of a signature without body are none of its bindings
            return self.types_only(node, inner)
        for x in (*node.type_params, *node.params, *([node.returns] if node.returns else [])):
            self.walk(x, inner)
        if node.body is not None:
            self.body(node.body, inner)

    def types_only(self, node: Node, scope: Scope) -> None:
        for p in node.type_params:
            self.walk(p, scope)
        for p in node.params:
            if p.type is not None:
                self.walk(p.type, scope)
        if node.returns is not None:
            self.walk(node.returns, scope)

    def on_FunctionType(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.types_only(node, Scope(scope, function=True))

    def on_Arrow(self, node: Node, scope: Scope) -> None:  # noqa: N802
        inner = Scope(scope, function=True)
        for x in (*node.type_params, *node.params, *([node.returns] if node.returns else [])):
            self.walk(x, inner)
        if node.body.kind == "Block":
            self.body(node.body, inner)
        else:
            self.walk(node.body, inner)

    def on_Class(self, node: Node, scope: Scope) -> None:  # noqa: N802
        inner = Scope(scope)
        if node.name is not None:
            self.declare(inner if node.form == "Expression" else scope, node.name, "class")
        for x in (*getattr(node, "decorators", []), *node.type_params, *([node.parent] if node.parent else []), *getattr(node, "parent_types", []), *getattr(node, "implements", []), *node.members):
            self.walk(x, inner)

    def on_Member(self, node: Node, scope: Scope) -> None:  # noqa: N802
        for x in (*node.decorators, getattr(node, "key", None), getattr(node, "type", None), getattr(node, "value", None)):
            if x is not None:
                self.walk(x, scope)
        if getattr(node, "init", None) is not None:
            self.walk(node.init, Scope(scope, function=True))

    def on_Catch(self, node: Node, scope: Scope) -> None:  # noqa: N802
        inner = Scope(scope)
        if node.param is not None:
            self.pattern(node.param, inner, "catch")
        self.body(node.body, inner)

    def on_For(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.below(node, Scope(scope))

    def on_Switch(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.walk(node.test, scope)
        inner = Scope(scope)
        self.hoist([x for x in node.body if x.kind in ("Function", "Class", "Variables")], inner)
        for x in node.body:
            self.walk(x, inner)

    def on_Enum(self, node: Node, scope: Scope) -> None:  # noqa: N802
        self.declare(scope, node.name, "enum")
        for x in node.items:
            self.walk(x, scope)

    def _typed(self, node: Node, scope: Scope) -> None:
        inner = Scope(scope)
        for x in (*node.type_params, *getattr(node, "bases", []), node.type):
            self.walk(x, inner)

    on_Interface = on_Alias = _typed

    def on_Namespace(self, node: Node, scope: Scope) -> None:  # noqa: N802
        for x in node.body:
            self.body(x, Scope(scope, function=True))

    def bindings(self, tree: Node) -> list[dict]:
        top = Scope(None, function=True)
        self.walk(tree, top)
        for scope, name in self.uses:
            symbol = scope.find(name)
            if symbol is not None:
                symbol["refs"] += 1
        return [s for s in self.symbols if s["kind"] is not None]


def extracted(source: str, ext: str, kinds: str = "all") -> dict:
    """functions, bindings, exports and parse_errors; a text that is no program has one error and nothing else."""
    text = source.removeprefix(chr(0xFEFF))
    try:
        tree = parse(text, ext)
        lines = Lines(text)
        reader = Reader(lines, KINDS[kinds])
        reader.walk(tree)
        found = Binder().bindings(tree)
    except (SyntaxProblem, RecursionError):
        return {"functions": [], "bindings": [], "exports": [], "parse_errors": 1}
    bindings = [
        {"name": s["name"], "kind": s["kind"], "exported": s["name"] in reader.names, "refs": s["refs"], "line": lines.line(s["at"]), "col": lines.col(s["at"])}
        for s in found
    ]
    return {"functions": reader.functions, "bindings": bindings, "exports": reader.exports, "parse_errors": 0}


def param_names(source: str, ext: str = "ts") -> list[str]:
    """How the parameters of the first function of a source are called: names, {...}, [...]."""
    tree, found = parse(source, ext), []

    def look(node: Node) -> None:
        if not found and node.kind in ("Function", "Arrow"):
            found.append(node)
        for child in node.children():
            look(child)

    look(tree)
    shapes = {"object": "{...}", "array": "[...]"}
    return [p.target.name if p.target.kind == "Name" else ("..." if p.init is not None else shapes[p.target.form]) for p in (found[0].params if found else [])]

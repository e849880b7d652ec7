"""The parser, the extractor and the nesting of names."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellum.plans import snippets
from tessellum.structure import nesting, scan
from tessellum.structure.extract import KINDS, extracted, param_names
from tessellum.structure.syntax import SyntaxProblem, Unsupported, parse

GOOD = {
    "ts": [
        "const f = async (a: number, b = 2): Promise<void> => { return a > b ? (x): y => 1 : z }",
        "const m: Map<string, Array<Map<a,b>>> = new Map<string, X>(); let y = a < b && c > d;",
        "abstract class A<T> extends B<T> implements C { private x = 1; static { foo(); } get z() { return 1 } async *gen() {} [k: string]: any; abstract m(): void; #p = 3; foo = () => 1 }",
        "type A<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] }; interface I { a(): void; b?: string; new (x): I } enum E { A = 1, B }",
        "import type { A } from 'a'; import B, { c as d, type E } from 'b'; import * as ns from 'n'; export { d as default }; export * from 'z';",
        "let v = obj as unknown as Foo<Bar>; const t = f<string>(x); x! + y!; if (a < b || c >= d >> 2) {}",
        "declare module 'x' { export function f(): void } namespace N.M { const q = 1 } declare const g: unique symbol;",
        "function f(x: unknown): asserts x is string {} const g = (x): x is string => true; type F = new (...a: any[]) => void;",
    ],
    "tsx": ["const A = () => <div className='x' onClick={() => go()}>hi {name} <b/> it's <>{...l}</></div>; const g = <T,>(x: T) => x;"],
    "js": [
        "a = b / c / d; x = /re[/]g/g.test(y); `t${a + `n${b}`}z`; for (const [k, v] of o) {} label: while(1) break label",
        "import {x, y} from 'z'\nconst a = 1\nexport default {a, b}\n(function () { return 1 })()\n;[1,2].map(x => x * 2)",
        "var o = { a, get c() { return 1 }, async d() {}, *e() {}, ['f' + g]: 2, ...h, async: 1, get: 2 }; x?.y?.[0]?.(z); a ??= b",
        "x = ((((a,b) => (c) => ({d})))); ((((((((((a))))))))))",
        "switch (a) { case 1: b(); default: c() } try { x() } catch { y } finally { z } do x++; while (x < 5) y()",
        "async function f() { for await (const x of y) await z; } const async = 1; async(x); yield_ = function* () { yield* a; yield }",
    ],
}


@pytest.mark.parametrize("ext,source", [(e, s) for e, ss in GOOD.items() for s in ss])
def test_programs_are_read(ext, source):
    parse(source, ext)


@pytest.mark.parametrize("source", ["export function ( {", "let = ;;(", "const a = 'x", "f(", "`${", "class {", "a b"])
def test_other_texts_are_not(source):
    with pytest.raises(SyntaxProblem):
        parse(source, "ts")
    assert extracted(source, "ts") == {"functions": [], "bindings": [], "exports": [], "parse_errors": 1}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab(){}[]<>=>,;:.?!'\"`/\\+- \n$#@*", max_size=40))
def test_no_text_breaks_the_reader(source):
    for ext in ("ts", "tsx", "js"):
        extracted(source, ext)


def test_unknown_extension():
    with pytest.raises(Unsupported):
        parse("x", "rb")


def test_names_exports_and_bindings():
    r = extracted(
        "export default function defFn() {}\nconst arr = () => 1;\nexport { arr };\nexport class Named { constructor() {} set s(v) {} static m() {} get g() { return this.s } }\n"
        "const o = { method() {} };\nfunction outer() { function inner() {} }\nenum K { A }\nimport q from 'q';\ntry {} catch (e) { e }\nexport { z as y } from 'z';",
        "ts",
    )
    assert {f["name"] for f in r["functions"]} >= {"defFn", "arr", "g", "s", "m", "method", "inner", "constructor"}
    assert [(x["name"], x["kind_code"]) for x in r["exports"]] == [("default", 2), ("defFn", 2), ("arr", 1), ("Named", 1), ("z", 1)]
    kinds = {b["name"]: b["kind"] for b in r["bindings"]}
    assert kinds["arr"] == "const" and kinds["K"] == "enum" and kinds["e"] == "catch" and kinds["q"] == "import"


def test_export_order_matters_for_functions_only():
    after = extracted("function foo() {}\nexport { foo };", "ts")
    before = extracted("export { foo };\nfunction foo() {}", "ts")
    assert [after["functions"][0]["exported"], before["functions"][0]["exported"]] == [False, True]
    assert after["bindings"][0]["exported"] and before["bindings"][0]["exported"]


def test_kinds_filter():
    source = "function top() {}\nconst a = () => 1;\nclass C { m() {} constructor() {} }\nconst o = { p() {} };\nconst x = function named() {};\ndeclare function ignored(): void;"
    found = {k: [f["kind"] for f in extracted(source, "ts", k)["functions"]] for k in KINDS}
    assert found == {"top": ["fn"], "top+arrow": ["fn", "arr"], "top+arrow+class": ["fn", "arr", "cls", "ctor"], "all": ["fn", "arr", "cls", "ctor", "obj", "fex"]}


def test_methods_hide_function_expressions():
    r = extracted("class C { m() { return function hidden() {}; } }\nconst seen = function named() {};\nconst memo = wrap(() => 1);", "ts")
    assert [f["name"] for f in r["functions"]] == ["m", "named", None]


def test_references_and_scopes():
    r = extracted("const a = 1;\nfunction f(a) { return a + a; }\nf(a);\nlet t: T; type T = typeof a;\nconst { b = a, ...c } = a;", "ts")
    assert [(b["name"], b["kind"], b["refs"]) for b in r["bindings"] if b["name"] == "a"] == [("a", "const", 4), ("a", "var", 2)]
    assert {b["name"] for b in r["bindings"]} == {"a", "f", "t", "b", "c"}


def test_columns_are_bytes():
    r = extracted("/* é☃ */ function f() {}\n", "js")
    assert (r["functions"][0]["line"], r["functions"][0]["col"], r["functions"][0]["line_end"]) == (1, 13, 1)


def test_param_names():
    assert param_names("const g = ([x], y, z = 2, {w}) => 0") == ["[...]", "y", "z", "{...}"]


def test_dotted_names():
    f = lambda n, a, b: {"name": n, "line": a, "line_end": b}
    assert nesting.dotted([f("builder", 1, 50), f("get", 10, 20)]) == ["builder", "builder.get"]
    assert nesting.dotted([f("outer", 1, 200), f("inner", 20, 150), f("leaf", 50, 60)]) == ["inner.leaf", "outer", "outer.inner"]
    assert nesting.dotted([f("a", 1, 1), f("b", 1, 1), f(None, 1, 9)]) == ["a.b", "b.a"]
    assert nesting.dotted([]) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_sweep_agrees_with_all_pairs(seed):
    r = random.Random(seed)
    spans = [(a := r.randint(1, 30), a + r.randint(0, 12)) for _ in range(r.randint(49, 120))]
    want = []
    for i, (s, e) in enumerate(spans):
        want.append(min(((b - a, j) for j, (a, b) in enumerate(spans) if j != i and a <= s and b >= e), default=(0, -1))[1])
    assert nesting._around(spans) == want


def test_scan_views_and_renderings(spark):
    files = snippets.script_files(spark).unionByName(spark.createDataFrame([("gone.ts", None, 1), ("x.rb", "1", 1)], "path string, content string, size int"))
    done = scan.scanned(files).cache()
    assert scan.stats(done).first().asDict() == {"files": 6, "parsed": 4, "skipped": 2, "errors": 3}
    out = {m: json.loads(scan.rendered(done, m, "/r")) for m in ("compact", "verbose", "files", "folders")}
    assert all(o["ver"] == 1 for o in out.values())
    assert len(out["compact"]["err"]) == 2 and len(out["compact"]["f"]) == 11
    assert out["verbose"]["functions"][0]["span"] == {"start": {"line": 3, "col": 8}, "end": {"line": 8, "col": 0}}
    assert out["files"]["files"]["app/main.ts"] == ["main", "main.shutdown"] and out["files"]["files"]["broken.ts"] == []
    assert out["folders"]["folders"]["."]["functions"] == 5
    done.unpersist()


def test_selected(spark):
    rows = [("a/x.ts", 5), ("node_modules/x.ts", 5), (".h/x.ts", 5), ("b.JSX", 5), ("c.py", 5), ("big.ts", 2_000_000), ("mine/x.ts", 5), ("n.js", None)]
    df = spark.createDataFrame([(p, "", s) for p, s in rows], "path string, content string, size int")
    assert sorted(r.path for r in scan.selected(df, exclude=["mine"]).collect()) == ["a/x.ts", "b.JSX", "n.js"]

"""Small sources for the structural queries, with what is expected of them, worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRIPTS = {
    "app/main.ts": "import run, { log as say } from './lib';\n\nexport async function main(args: string[]) {\n  const shutdown = () => {\n    say(args);\n  };\n  await run(shutdown);\n}\n",
    "app/store.ts": "class Store {\n  constructor(private size = 1) {}\n  get full() { return this.size > 9; }\n  add(x) { return [1].map((y) => x + y); }\n}\nexport { Store };\nexport default new Store();\n",
    "lib.js": "export const twice = (f) => function again(x) { return f(f(x)); };\nexport function* count() { let i = 0; while (true) yield i++; }\nconst o = { m() {}, set v(q) {}, n: 1 };\n",
    "broken.ts": "export function ( {\n",
}
FUNCTIONS = [
    ("app/main.ts", 3, 8, "main", 1, "fn"),
    ("app/main.ts", 4, 20, "shutdown", 1, "arr"),
    ("app/store.ts", 2, 3, "constructor", 0, "ctor"),
    ("app/store.ts", 3, 3, "full", 0, "get"),
    ("app/store.ts", 4, 3, "add", 0, "cls"),
    ("app/store.ts", 4, 27, "", 0, "arr"),
    ("lib.js", 1, 22, "twice", 1, "arr"),
    ("lib.js", 1, 29, "again", 1, "fex"),
    ("lib.js", 2, 8, "count", 1, "fn"),
    ("lib.js", 3, 13, "m", 0, "obj"),
    ("lib.js", 3, 21, "v", 0, "set"),
]
BINDINGS = [
    ("app/main.ts", 1, 8, "run", "import", 1),
    ("app/main.ts", 1, 22, "say", "import", 1),
    ("app/main.ts", 3, 23, "main", "fn", 0),
    ("app/main.ts", 3, 28, "args", "var", 1),
    ("app/main.ts", 4, 9, "shutdown", "const", 1),
    ("app/store.ts", 1, 7, "Store", "class", 2),
    ("app/store.ts", 2, 23, "size", "var", 0),
    ("app/store.ts", 4, 7, "x", "var", 1),
    ("app/store.ts", 4, 28, "y", "var", 1),
    ("lib.js", 1, 14, "twice", "const", 0),
    ("lib.js", 1, 23, "f", "var", 2),
    ("lib.js", 1, 38, "again", "fn", 0),
    ("lib.js", 1, 44, "x", "var", 1),
    ("lib.js", 2, 18, "count", "fn", 0),
    ("lib.js", 2, 32, "i", "let", 1),
    ("lib.js", 3, 7, "o", "const", 0),
    ("lib.js", 3, 27, "q", "var", 0),
]
EXPORTS = [("app/main.ts", "main", 1), ("app/store.ts", "Store", 1), ("app/store.ts", "default", 2), ("lib.js", "twice", 1), ("lib.js", "count", 1)]
FOLDERS = [
    (".", 5, ["again.twice", "count", "m.v", "twice.again", "v.m"]),
    ("app", 6, ["add", "constructor", "full", "main", "main.shutdown"]),
]

CODE = {
    "a.py": "import os\nx = 1\n\n\n@wrap\ndef f(a):\n    return a\n\n\nif x:\n    f(x)\n",
    "b.rs": "use std::fmt;\n\n#[derive(Debug)]\npub struct P { x: i32 }\n\nimpl P {\n    fn new() -> Self { P { x: 1 } }\n}\n",
    "c.go": "package main\n\nimport \"fmt\"\n\nfunc main() {\n\tfmt.Println(1)\n}\n",
    "d.ts": "import a from 'b';\n// note\nif (a) go(a);\nexport const c = () => 1;\n",
    "e.md": "# One\ntext\n# Two\nmore\n",
    "f.toml": "[x]\ny = 1\n",
}
CODE_CHUNKS = {
    "a.py": ["import os\nx = 1", "@wrap\ndef f(a):\n    return a\nifx:f(x)"],
    "b.rs": ["use std::fmt;\n#[derive(Debug)]", "pub struct P { x: i32 }", "impl P {\n    fn new() -> Self { P { x: 1 } }\n}"],
    "c.go": ["packagemain\nimport \"fmt\"", "func main() {\n\tfmt.Println(1)\n}"],
    "d.ts": ["import a from 'b';\n// noteif(a)go(a);", "export const c = () => 1;"],
    "e.md": ["# One\ntext", "# Two\nmore"],
    "f.toml": ["[x]\ny = 1"],
}


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def script_files(spark: SparkSession) -> DataFrame:
    df = _table(spark, list(SCRIPTS.items()), "path string, content string")
    return df.withColumn("size", F.octet_length("content"))


def code_files(spark: SparkSession) -> DataFrame:
    return _table(spark, list(CODE.items()), "file_path string, content string")


def sql_text(x: object) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(sql_text, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(which: str, columns: str) -> str:
    rows = {"functions": FUNCTIONS, "bindings": BINDINGS, "exports": EXPORTS, "folders": FOLDERS}[which]
    picked = columns.replace("functions", "functions::BIGINT AS functions") if which == "folders" else "*"
    return f"SELECT {picked} FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows) + f") t({columns})"

"""The three splitters: golden cases, and invariants over random texts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.operators import chunking as C
from tessellum.plans import snippets

TEXTS = st.lists(st.text(alphabet="ab é#\t☃", max_size=30), max_size=40).map("\n".join)


def test_plain_small_texts():
    assert C.plain("a\nb\nc", 1000, 0) == ["a\nb\nc"]
    assert C.plain("") == C.plain(" \n\t\n ") == []
    assert C.plain("x" * 5000, 200, 0) == ["x" * 5000]


def test_plain_tail_repeats_the_last_lines():
    ten = [f"l{i}" for i in range(10)]
    assert C.plain("\n".join(ten)) == ["\n".join(ten), "l8\nl9"]
    assert C.plain("l0\nl1") == ["l0\nl1"]
    assert C.plain("l0\nl1\nl2") == ["l0\nl1\nl2", "l1\nl2"]


def test_plain_counts():
    assert len(C.plain("\n".join(f"this is line number {i}" for i in range(100)), 200, 50)) == 15
    chunks = C.plain("\n".join(f"line-{i:03}" for i in range(100)), 200, 120)
    assert len(chunks) == 7
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert a.split("\n")[-1] in b.split("\n")


def test_plain_without_overlap_repeats_nothing():
    chunks = C.plain("\n".join(f"unique {i}" for i in range(50)), 200, 0)
    lines = [x for c in chunks for x in c.split("\n")]
    assert len(chunks) > 1 and len(lines) == len(set(lines)) == 50


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60), st.integers(0, 130))
def test_plain_against_the_rule_line_by_line(source, size, overlap):
    rows, out, start = tx.lines(source), [], 0
    while start < len(rows):
        end, used = start, 0
        while end < len(rows) and used + len(rows[end].encode()) < size:
            used += len(rows[end].encode()) + 1
            end += 1
        end = max(end, start + 1)
        if tx.trim("\n".join(rows[start:end])):
            out.append("\n".join(rows[start:end]))
        back = overlap // 40
        again = end - back if end > back else end
        start = end if again <= start else again
    assert C.plain(source, size, overlap) == out


def test_markdown():
    assert C.markdown("# One\ntext\n# Two\nmore\n") == ["# One\ntext", "# Two\nmore"]
    assert [len(c.encode()) for c in C.markdown("# T\n" + "a" * 30 + "\n# U\nb\n", 20, 10)] == [34, 9, 5]
    assert [len(c.encode()) for c in C.markdown("\n".join(["aaaa"] * 5), 8, 100)] == [9, 14, 19, 24, 24]
    many = C.markdown("# Big Section\n" + "\n".join(f"Filler line {i} with some words" for i in range(50)), 200, 50)
    assert len(many) > 1 and many[0].startswith("# Big Section")
    assert C.markdown("") == C.markdown(" \n ") == []


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 60), st.integers(0, 40))
def test_markdown_loses_no_word(source, size, overlap):
    words = set(source.split())
    assert {w for c in C.markdown(source, size, overlap) for w in c.split()} >= words


def test_code_golden():
    for name, source in snippets.CODE.items():
        assert C.split(source, name.rsplit(".", 1)[1], 40, 0) == snippets.CODE_CHUNKS[name], name


def test_code_keeps_declarations_whole():
    source = "\n\n".join(f"def f{i}(a):\n    return '{'x' * i}'" for i in range(30))
    chunks = C.split(source, "py", 200, 50)
    for i in range(30):
        assert any(f"def f{i}(a):\n    return '{'x' * i}'" in c for c in chunks)


def test_code_that_cannot_be_read_is_split_by_lines():
    for ext in ("ts", "py", "rs", "go"):
        assert C.split("fn ( { [", ext) == ["fn ( { ["]
        assert C.split("", ext) == []


def test_rust_and_go_items():
    rust = 'pub(crate) const fn a() -> [u8; 2] { [1, 2] }\nconst X: &str = "}";\npub struct T(i32);\nmacro_rules! m { () => {} }\nextern crate z;\nfn life<\'a>(x: &\'a str) -> char { \'}\' }\n'
    out = C.split(rust, "rs", 1, 0)
    assert "const X: &str = \"}\";" in out and "pub struct T(i32);" in out and any(c.startswith("pub(crate) const fn a()") for c in out)
    assert any(c.endswith("fn life<'a>(x: &'a str) -> char { '}' }") for c in out)
    go = "package p\n\nvar (\n\ta = 1\n)\ntype I interface {\n\tF() struct{}\n}\nfunc (t *T) F(x interface{}) map[string]int {\n\treturn nil\n}\n"
    out = C.split(go, "go", 1, 0)
    assert "type I interface {\n\tF() struct{}\n}" in out and any(c.startswith("func (t *T) F") and c.endswith("}") for c in out)


def test_chunked_table(spark):
    rows = [("a.md", "# A\nx\n# B\ny"), ("b.txt", "z"), ("c.py", None), ("d.rs", ""), (None, "q")]
    df = spark.createDataFrame(rows, "file_path string, content string").withColumn("chunk_size", F.lit(1))
    got = {(r.file_path, r.chunk_no): r.chunk for r in C.chunked(df).collect()}
    assert got == {("a.md", 0): "# A\nx", ("a.md", 1): "# B\ny", ("b.txt", 0): "z", (None, 0): "q"}

"""Paths, bytes and vectors as columns."""

import functools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellum.functions import paths, vectors
from tessellum.functions import text as tx


@pytest.fixture(autouse=True, scope="module")
def _column(spark):
    globals()["c"] = F.col("p")  # a column needs a session


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, p {kind}")
    return [r[0] for r in df.orderBy("i").select(f).collect()]


def test_extensions(spark):
    names = ["a.rs", "main.RS", "archive.tar.gz", ".git/HEAD", "noext", "foo.", ".gitignore", "rs", "x/y.md", "z.json", "", ".", None]
    assert column(spark, names, paths.is_indexable(c)) == [True, False, False, False, False, False, False, True, True, True, False, False, False]
    assert column(spark, names[4:7], paths.extension(c)) == ["noext", "", "gitignore"]
    assert column(spark, ["a.tsx", "b.mjs", "c.yml", "d.txt", None], paths.language(c)) == ["typescript", "javascript", "yaml", "", None]
    assert column(spark, ["a.TS", ".ts", "d/b.jsx", "ts", None], paths.has_extension(c, paths.SCANNED)) == [True, False, True, False, False]
    assert [paths.language_filter(x) for x in ("ts", "tsx", "typescript", "klingon")] == ["typescript", "typescript", "typescript", "klingon"]


def test_folders(spark):
    assert column(spark, ["a/b/c.ts", "c.ts", None], paths.parent_dir(c)) == ["a/b", ".", None]
    assert column(spark, ["/r/a/b", "/r", "/q/a", "/r/x/"], paths.relative("/r", c)) == ["a/b", "", "", "x"]
    assert column(spark, ["a/dist/b.ts", "dist.ts", "a/b.ts"], paths.below_excluded(c, paths.SCAN_EXCLUDED)) == [True, False, False]
    assert column(spark, ["a/.x/b", ".env", "a/b.c"], paths.hidden(c)) == [True, True, False]


def test_tree_names(spark):
    assert column(spark, ["node_modules", ".x", "tests", "src"], paths.skipped_folder(c)) == [True, True, True, False]
    assert column(spark, ["node_modules", "tests"], paths.skipped_folder(c, True)) == [True, False]
    assert column(spark, ["Dockerfile", "a.css", ".env", "a.bin"], paths.shown_file(c)) == [True, True, True, False]
    assert column(spark, ["index.test.ts", "Cargo.toml", "Dockerfile", "ts"], paths.strip_known(c)) == ["index.test", "Cargo.toml", "Dockerfile", "ts"]


def natural(a, b):
    import re

    x, y = (re.findall("[0-9]+|[^0-9]+", s.translate({i: i + 32 for i in range(65, 91)})) for s in (a, b))
    for p, q in zip(x, y, strict=False):
        u, v = (int(p), int(q)) if p.isdigit() and q.isdigit() else (p, q)
        if u != v:
            return -1 if u < v else 1
    return (len(x) > len(y)) - (len(x) < len(y)) or (a > b) - (a < b)


def test_natural_order(spark):
    names = ["file10", "file2", "file1", "File3", "v1.2.10", "v1.2.3", "9", "10", "Abc", "abc", "file", "a01", "a1", "é2", "é10", "1a", "-1"]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "p string").orderBy(paths.natural_key(c)).collect()]
    assert got == sorted(names, key=functools.cmp_to_key(natural))


def test_cut_and_snippets(spark):
    texts = ["abc", "aé☃𝄞" * 3, "é" * 10, ""]
    for most in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11):
        want = [t.encode()[:most].decode(errors="ignore") for t in texts]
        assert column(spark, texts, tx.cut_bytes(c, most)) == want
    assert column(spark, ["x" * 1200, "x" * 1201], tx.snippet(c)) == ["x" * 1200, "x" * 1200 + "\n..."]


def test_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\r", "\n\n", "a\r\r\n", "x\ny\n"]
    want = [[], ["a"], ["a"], ["a", "b"], ["a\r"], ["", ""], ["a\r"], ["x", "y"]]
    assert [tx.lines(t) for t in texts] == want
    assert column(spark, texts, tx.lines_of(c)) == want


def test_blank(spark):
    assert column(spark, ["", " \t\n", " 　", "\x1c", "a"], tx.is_blank(c)) == [True, True, True, False, False]
    assert tx.trim("  a\x1c ") == "a\x1c"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.integers(-3, 30))
def test_tail_from_begins_at_a_character(text, at):
    raw = text.encode()
    out = tx.tail_from(raw, at)
    out.decode()
    assert raw.endswith(out) and len(raw) - max(0, at) - 3 <= len(out) <= max(0, len(raw) - max(0, at))


def test_cosine(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-3.0, 4.0]), (3, None), (4, [1.0])]
    df = spark.createDataFrame(rows, "i int, p array<double>")
    got = {r.i: r.s for r in df.select("i", vectors.cosine(c, F.array(F.lit(3.0), F.lit(4.0))).alias("s")).collect()}
    assert got[0] == pytest.approx(0.6) and math.isnan(got[1]) and got[2] == pytest.approx(7 / 25) and got[3] is None and got[4] is None


def test_padding(spark):
    assert column(spark, [[1.0, 2.0]], vectors.padded(c, 4), "array<float>") == [[1.0, 2.0, 0.0, 0.0]]
    with pytest.raises(Exception, match="beyond"):
        column(spark, [[1.0] * 5], vectors.padded(c, 4), "array<float>")

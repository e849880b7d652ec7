"""Search, the state algebra and trees on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tessellum.operators import search, state, tree

CHUNKS = "id int, content string, project string, source string, language string, embedding array<float>, note string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "a", "p", "x.ts", "typescript", [1.0, 0.0]),
        (2, "b", "p", "x.ts", "typescript", [1.0, 1.0]),
        (3, "c", "p", "y.py", "python", [0.0, 1.0]),
        (4, "d", "p", "z.py", "python", [-1.0, 0.0]),
        (5, "e", "p", "w.md", "markdown", [0.0, 0.0]),
        (6, "f", "q", "x.ts", "typescript", [1.0, 0.0]),
        (7, "g", "p", "n.ts", "typescript", None),
        (8, "é" * 700, "p", "v.ts", "typescript", [1.0, 0.0]),
        (9, "h", "p", "u.ts", "typescript", [1.0]),
    ]
    return spark.createDataFrame([(*r, "score") for r in rows], CHUNKS)


def ids(df):
    return [r.id for r in df.collect()]


def test_order_ties_and_zero_vectors(chunks):
    assert ids(search.similar(chunks, [1.0, 0.0], project="p", threshold=-1)) == [1, 8, 2, 3, 4, 5]


def test_threshold_works_behind_the_limit(chunks):
    assert ids(search.similar(chunks, [1.0, 0.0], limit=4, threshold=0.9, project="p")) == [1, 8]
    assert ids(search.similar(chunks, [1.0, 0.0], limit=2, threshold=1.0, project="p")) == [1, 8]  # equal is enough
    assert ids(search.similar(chunks, [0.0, 1.0], limit=1, threshold=0.0, language="md")) == [5]  # NaN is not below


def test_filters(chunks):
    assert ids(search.similar(chunks, [1.0, 0.0], language="tsx", project="q")) == [6]
    assert ids(search.similar(chunks, [1.0, 0.0], language="cobol")) == []


def test_top_k_is_one_pass_without_a_sort_shuffle(chunks):
    plan = search.similar(chunks, [1.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Python" not in plan


def test_blank_query():
    with pytest.raises(ValueError, match="empty"):
        search.query_text([" ", "\t"])
    assert search.query_text(["a", "b c"]) == "a b c"


def test_renderings(chunks):
    found = search.similar(chunks, [1.0, 0.0], limit=9, threshold=-1, project="p")
    first = json.loads(search.json_text(found))[2]
    assert first == {"file": "x.ts", "language": "typescript", "score": 0.707, "content": "b"}
    assert search.json_text(found.where("false")) == "[]"
    best = {r.source: r.line for r in search.best_of_files(found).collect()}
    assert best == {"x.ts": "x.ts  (100.0%)", "v.ts": "v.ts  (100.0%)", "y.py": "y.py  (0.0%)", "z.py": "z.py  (0.0%)", "w.md": "w.md  (0.0%)"}
    text = {r.id: r.snippet for r in search.snippets(found).collect()}
    assert text[2] == "\n### x.ts  (70.7%)\n```typescript\nb\n```"
    assert text[8] == "\n### v.ts  (100.0%)\n```typescript\n" + "é" * 600 + "\n...\n```"


FILES, HASHES = "project string, file_path string, content string, size long", "project string, file_path string, content_hash string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("p", "same", "1", 1), ("p", "new", "2", 1), ("p", "edited", "3", 1), ("p", "unreadable", None, 1), ("p", "large", "4", 600_000), ("q", "only", "5", 1), ("p", "", "", 0)]
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def hashes(spark):
    h = spark.createDataFrame([("p", "same", "1"), ("p", "edited", "0"), ("p", "gone", "9"), ("p", "unreadable", "7"), ("p", "large", "x")], HASHES)
    return h.withColumn("content_hash", F.sha2("content_hash", 256))


def test_changed_and_classified(files, hashes):
    assert sorted(r.file_path for r in state.changed(files, hashes).collect()) == ["", "edited", "new", "only"]
    assert sorted(r.file_path for r in state.changed(files, hashes, force=True).collect()) == ["", "edited", "new", "only", "same"]
    got = {r.file_path: r.status for r in state.classified(files, hashes).collect()}
    assert got == {"same": "unchanged", "new": "changed", "edited": "changed", "unreadable": "unreadable", "large": "oversized", "only": "changed", "": "changed"}
    assert {r.status for r in state.classified(files, hashes, force=True).collect()} == {"changed", "unreadable", "oversized"}


def test_stale(files, hashes):
    got = {r.file_path: r.reason for r in state.stale(files, hashes).collect()}
    assert got == {"new": "new", "edited": "changed", "gone": "deleted", "large": "changed", "only": "new", "": "new"}
    assert {r.project: r.n_stale for r in state.stale_count(files, hashes).collect()} == {"p": 5}  # q has no hashes: no warning
    few = {r.project: (r.n_stale, r.paths, r.more) for r in state.stale_report(files, hashes, 2).collect()}
    assert few == {"p": (5, ["", "edited"], 3), "q": (1, ["only"], 0)}
    assert [r.file_path for r in state.deleted(files, hashes).collect()] == ["gone"]


def test_counters_and_rewrites(spark, files, hashes):
    old = spark.createDataFrame([("1", "p", "edited"), ("2", "p", "edited"), ("3", "p", "gone"), ("4", "p", "same")], "id string, project string, source string")
    statuses = state.classified(files, hashes)
    wrote = statuses.where("status = 'changed' and file_path <> ''")
    got = {r.project: tuple(r)[1:] for r in state.counters(statuses, wrote, old, state.deleted(files, hashes)).collect()}
    assert got == {"p": (1, 2, 1, 3), "q": (1, 0, 0, 0)}
    left = state.without_files(old, wrote.select("project", "file_path"))
    assert left.columns == old.columns and sorted(r.id for r in left.collect()) == ["3", "4"]
    assert [tuple(r) for r in state.removed_count(old, wrote).collect()] == [("p", "edited", 2)]
    assert [r.id for r in state.cleared(old, "p").collect()] == []


def test_upsert_keeps_what_it_shall(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, made int, v int")
    new = spark.createDataFrame([("b", 9, 21), ("c", 9, 30)], "k string, made int, v int")
    assert sorted(map(tuple, state.upserted(old, new, ["k"]).collect())) == [("a", 1, 10), ("b", 9, 21), ("c", 9, 30)]
    assert sorted(map(tuple, state.upserted(old, new, ["k"], keep=["made"]).collect())) == [("a", 1, 10), ("b", 2, 21), ("c", 9, 30)]


def test_configurations(spark):
    chunks = spark.createDataFrame([(1, "b", "p", None, 3), (2, "b", "p", "m2", 3), (3, "b", "p", "m3", 3), (4, "c", None, None, None)], "id int, project string, provider string, model string, dimensions int")
    projects = spark.createDataFrame([("a", "s", "t", 1)], "project string, provider string, model string, dimensions int")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "project string")
    got = sorted(map(tuple, state.resolved_config(names, projects, chunks, ("d", "e", 2)).collect()))
    assert got == [("a", "s", "t", 1, "stored"), ("b", "p", "m2", 3, "inferred"), ("c", "d", "e", 2, "default")]


def test_project_list(spark, chunks):
    projects = spark.sql(
        "select 'p' project, 'openai' provider, 'm' model, 2 dimensions, timestamp'2024-01-02 03:04:05' updated_at union all select 'empty', null, 'm', 2, timestamp'2025-01-01 00:00:00'"
    )
    listed = state.project_list(projects, chunks)
    assert [tuple(r) for r in listed.collect()] == [("empty", 0, 0, None, "2025-01-01 00:00"), ("p", 8, 7, "openai:m (2d)", "2024-01-02 03:04")]
    assert state.list_report(listed).first().report == "empty\n  Files: 0  Chunks: 0  Embed: unknown  Updated: 2025-01-01 00:00"


def node(dirs=(), files=()):
    return tree.built([("", list(files)), *[(d, list(f)) for d, f in dirs]])


def test_tree_counts(spark):
    assert node([("a", ["x"]), ("b", ["y"])], "123").summary() == "(2d 5f)"
    assert node([("a", [])]).summary() == "(1d)" and node([], "1").summary() == "(1f)" and node().summary() == "()"
    paths = ["a/1.ts", "a/a1/2.ts", "a/a1/3.ts", "b/4.ts", "5.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    got = {r.folder: r.summary for r in tree.counts(df).collect()}
    assert got == {"": "(3d 5f)", "a": "(1d 3f)", "a/a1": "(2f)", "b": "(1f)"}


def test_tree_drawing():
    assert tree.drawn(node([("a", []), ("a/b", []), ("a/b/c", ["x", "y"])])) == ["a/b/c/  x, y"]
    assert tree.drawn(node([("a", [])])) == ["a/"]
    eight = tree.drawn(node([("a", list("12345678"))]), inline=3)
    assert eight == ["a/", "  1, 2, 3", "  4, 5, 6", "  7, 8"]
    assert tree.drawn(node([("a", ["x", "y"]), ("a/b", ["z"])]), depth=1) == ["a/ (1d 3f)"]
    assert tree.drawn(tree.built([("s/a", ["x"])], "s")) == ["s/", "a/  x"]


def test_outline(spark):
    df = spark.createDataFrame([("src/b10.ts",), ("src/b2.ts",), ("README",), ("tests/x.ts",), ("img.png",)], "file_path string")
    text = tree.outline(df, empty=["void"])
    assert text == "# Project Structure\n\nsrc/  b2, b10\nvoid/\nREADME\n\n# ~12 tokens (47 chars, 5 lines)\n"
    assert "tests/  x" in tree.outline(df, everything=True)

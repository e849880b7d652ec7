"""What keeps large inputs within bounds: tasks, passes, bytes in Python, what is written."""

from pyspark.sql import functions as F

from tessellum.functions import batches
from tessellum.plans import snippets
from tessellum.structure import scan
from tessellum.structure.extract import KINDS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_partition_are_parsed_on_all_cores(spark):
    files = spark.range(400).select(F.concat("id", F.lit(".ts")).alias("path"), F.lit("let x = 1;").alias("content"))
    rows = scan.scanned(files.coalesce(1)).select(F.spark_partition_id().alias("p"), "index.bindings").collect()
    assert len(rows) == 400 and all(len(r["bindings"]) == 1 for r in rows)
    assert len({r["p"] for r in rows}) >= spark.sparkContext.defaultParallelism


def test_parts_are_small_and_whole():
    import pyarrow as pa

    texts = pa.array(["a" * batches.PART_BYTES * 2, None, "", *["b" * 1000] * 3000, "c"])[1:]
    cut = list(batches.parts(texts))
    assert [i for i, _ in cut] == [0, *[j for _, j in cut[:-1]]] and cut[-1][1] == len(texts)
    assert all(j - i <= batches.PART_ROWS and sum(map(len, filter(None, texts[i:j].to_pylist()))) <= batches.PART_BYTES for i, j in cut)
    assert list(batches.parts(pa.array([], pa.string()))) == []
    assert list(batches.parts(pa.array(["a" * batches.PART_BYTES * 2, "b"]))) == [(0, 1), (1, 2)]


def test_a_filter_on_the_index_does_not_parse_again(spark):
    found = scan.scanned(snippets.script_files(spark))
    for view in (scan.files_view(found), scan.folders_view(found), scan.stats(found)):
        assert plan(view).count("[index(") == 1


def test_all_filters_of_kinds_take_one_scan(spark):
    files = snippets.script_files(spark)
    view = scan.kinds_view(scan.scanned(files), list(KINDS))
    assert plan(view).count("[index(") == 1
    want = [(k, *r) for k in KINDS for r in scan.compact_functions(scan.scanned(files, k)).collect()]
    assert sorted(map(tuple, view.collect())) == sorted(want)


def test_texts_are_split_a_part_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from tessellum.operators import chunking

    texts = ["a\n" * 600_000, None, "", "b\n" * 1000] + ["c\n" * 1000] * 3000
    seen = []
    out = chunking._by_parts(lambda t: seen.append(t.nbytes) or [None if x is None else chunking.plain(x) for x in t.to_pylist()], pa.array(texts))
    assert out.to_pylist() == [None if t is None else chunking.plain(t) for t in texts]
    assert len(seen) >= 7 and max(seen[1:]) <= batches.PART_BYTES * 1.1

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    files = spark.createDataFrame([("a.md", "x")], "file_path string, content string")
    chunking.chunked(files)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= batches.BATCH_BYTES


SCHEMA = "project string, file_path string, content string, size long"


def test_vectors_are_written_once_and_stay_where_they_are(spark, tmp_path, monkeypatch):
    from tessellum.engine import Engine
    from tessellum.sources import store

    e = Engine(spark, f"file://{tmp_path}/store")
    e.store.bucket_bytes = 8192
    seen = []
    add = store.Store.add
    monkeypatch.setattr(store.Store, "add", lambda self, name, project, rows, n, version: seen.append((name, plan(rows))) or add(self, name, project, rows, n, version))

    def files(edited=()):
        return spark.createDataFrame([("p", f"f{i}.md", f"# {i}\n" + "text " * 50 + ("!" if i in edited else ""), 260) for i in range(40)], SCHEMA)

    assert e.index_table(files(), "p") == {"added": 40, "skipped": 0, "updated": 0, "deleted": 0}
    # of the vectors' rows only the contents are shuffled, before vectors are made of them
    made = [p for name, p in seen if name == "chunks" and "ArrowEvalPython" in p]
    assert len(made) == 1 and made[0].index("ArrowEvalPython") < made[0].index("Exchange")
    assert not list(tmp_path.glob("store/staged/*"))
    seen.clear()
    assert e.index_table(files({3, 7}), "p") == {"added": 0, "skipped": 38, "updated": 2, "deleted": 2}
    kept = [p for name, p in seen if name == "chunks" and "ArrowEvalPython" not in p]
    assert kept and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p and "repartition" not in p.lower() for p in kept)
    rows = e.store.read("chunks", "p").collect()
    assert len(rows) == 40 and {r.source for r in rows if r.content[-1] == "!"} == {"f3.md", "f7.md"} and e.store.read("hashes", "p").count() == 40


def test_buckets_of_many_small_files_are_brought_together(spark, tmp_path, monkeypatch):
    from tessellum.engine import Engine
    from tessellum.sources import store

    monkeypatch.setattr(store, "FRAGMENTS", 2)
    e = Engine(spark, f"file://{tmp_path}/store")
    for k in range(6):
        table = spark.createDataFrame([("p", f"f{i}.md", f"# {i} of {k if i == k else 9}", 9) for i in range(8)], SCHEMA)
        e.index_table(table, "p")
    assert e.store.read("chunks", "p").count() == 8 and len(e.store.read("chunks", "p").inputFiles()) <= 4


def test_keys_are_broadcast_in_rounds():
    from tessellum.sources.store import _rounds

    assert _rounds({3: 5, 1: 5, 2: 6, 4: 20, 5: 1}, 11) == [[1, 2], [3], [4], [5]] and _rounds({}, 9) == []


def test_contents_do_not_go_through_the_join_with_hashes(spark):
    from tessellum.operators import state

    files = spark.createDataFrame([("p", "a", "x", 1), ("p", "b", None, 1)], SCHEMA)
    hashes = spark.createDataFrame([("p", "a", "0")], "project string, file_path string, content_hash string")
    rows = state.classified(files.repartition(3), hashes.hint("merge"))
    assert {(r.file_path, r.status) for r in rows.collect()} == {("a", "changed"), ("b", "unreadable")}
    sent = [line for line in plan(rows.drop("content")).split("\n") if "sha2(" in line]
    assert len(sent) == 1 and ", content#" not in sent[0]

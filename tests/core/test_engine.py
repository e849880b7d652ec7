"""Projects on disk, end to end: index, search, status, tree, scan, stream."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tessellum.engine import Engine
from tessellum.operators import embedding
from tessellum.operators.embedding import Config, Hashed, Http, KeyRejected, RejectedKeys
from tessellum.sources import files as sources
from tessellum.sources.store import Changed
from tessellum.streaming import incremental


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def git(root, *args):
    subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *args], cwd=root, check=True, capture_output=True)


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    put(root, "src/a.ts", "export function alpha() { return 1 }\n")
    put(root, "src/b c [1].py", "def beta():\n    return 'größe'\n")
    put(root, "README.md", "# Title\nhello alpha\n")
    put(root, "bad.json", b"\xff\xfe{}")
    put(root, "empty.ts", "")
    put(root, "big.md", "x" * 600_000)
    put(root, "skip/z.ts", "const z = 1")
    put(root, ".gitignore", "skip/\n")
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "x")
    return root


def test_life_of_an_index(spark, project, tmp_path):
    root, e = str(project), Engine(spark, f"file://{tmp_path}/store", default=Config("hashed", "words-256", 256))
    assert e.list() == "No indexed projects.\n"
    e.setup()
    e.setup()
    assert e.index(root) == {"added": 3, "skipped": 1, "updated": 0, "deleted": 0}
    assert e.index(root) == {"added": 0, "skipped": 4, "updated": 0, "deleted": 0}
    assert e.stale(root) == 2  # the large file and the empty one have no hash, ever
    assert e.search(["alpha", "function"], root).first().source == "src/a.ts"
    assert {r.language for r in e.search("beta", root, language="py").collect()} == {"python"}
    put(project, "src/a.ts", "export function gamma() {}\n")
    (project / "README.md").unlink()
    status = e.status(root)
    assert "Stale   : 4 ⚠" in status and "  • README.md\n" in status and "hashed:words-256 (256d)" in status
    assert e.index(root) == {"added": 0, "skipped": 2, "updated": 1, "deleted": 1}
    assert {r.source for r in e.store.read("chunks").collect()} == {"src/a.ts", "src/b c [1].py", "README.md"}
    assert e.index(root, force=True) == {"added": 0, "skipped": 1, "updated": 2, "deleted": 3}
    assert {r.source for r in e.store.read("chunks").collect()} == {"src/a.ts", "src/b c [1].py"}
    assert {r.file_path for r in e.store.read("hashes").collect()} >= {"README.md"}  # hashes of swept files stay
    assert e.index(root, file="src/a.ts") == {"added": 0, "skipped": 0, "updated": 1, "deleted": 1}
    with pytest.raises(ValueError, match="reindex"):
        e.index(root, embedding_spec="openai:text-embedding-3-small")
    before = e.store.read("projects").first().created_at
    assert e.reindex(root) == {"added": 2, "skipped": 1, "updated": 0, "deleted": 0}
    assert e.store.read("projects").first().created_at > before
    assert "Files: 2  Chunks: 2" in e.list()
    assert e.store.vacuum() > 0 and e.store.read("chunks").count() == 2
    assert e.clear(root) == 2 and e.list() == "No indexed projects.\n"


def test_a_failing_provider_changes_nothing(spark, project, tmp_path):
    def broken(_):
        def call(texts):
            raise RuntimeError("no vectors today")

        return lambda: call

    e = Engine(spark, f"file://{tmp_path}/store", default=Config("hashed", "words-256", 256))
    e.index(str(project))
    put(project, "src/a.ts", "changed")
    e._providers = broken
    with pytest.raises(Exception, match="no vectors"):
        e.index(str(project), force=True)
    assert e.store.read("chunks").count() == 3 and "Stale   : 3" in e.status(str(project))


def test_tree_and_scan(spark, project, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.tree(str(project)).startswith("# Project Structure\n\nskip/  z\nsrc/  a, b c [1]\nbad.json, big.md, empty, README.md\n")
    assert e.tree(str(project), "src").split("\n")[2] == "src/  a, b c [1]"
    with pytest.raises(ValueError, match="inside"):
        e.tree(str(project), "../..")
    rows = {r.path: r["index"] for r in e.scan(str(project)).collect()}
    assert set(rows) == {"src/a.ts", "empty.ts"} and rows["src/a.ts"].functions[0].name == "alpha"
    assert e.scan(str(project), file="bad.json").first()["index"].error.startswith("failed to read")


def test_stream(spark, project, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", default=Config("hashed", "words-256", 256))
    for text in ("one", "two"):
        put(tmp_path, f"in/{text}/a.md", f"# {text}\n")
        rows = incremental.watched(spark, str(tmp_path / "in"), "live")
        incremental.indexing(rows, e, "live", f"file://{tmp_path}/check").awaitTermination(120)
        assert (project.exists(), e.store.read("chunks").where(F.col("content") == f"# {text}").count()) == (True, 1)
    assert e.store.read("hashes").count() == 2


def test_discovery(project, tmp_path):
    root = str(project)
    assert sorted(sources.git_files(root)) == ["README.md", "bad.json", "big.md", "empty.ts", "src/a.ts", "src/b c [1].py"]
    other = tmp_path / "more"
    other.write_text("*.md\n")
    git(project, "rm", "-q", "--cached", "big.md")
    assert "big.md" not in sources.git_files(root, str(other))
    assert sources.project_id(root) == sources.project_id(f"{root}/src") == os.path.realpath(root)
    outside = tmp_path / "plain"
    outside.mkdir()
    assert sources.project_id(str(outside)) == os.path.realpath(outside)
    with pytest.raises(ValueError, match="git"):
        sources.git_files(str(outside))
    assert sources.relative_file("/r", "/r/a/b") == "a/b" and sources.relative_file("/r", "/q/x") == "/q/x" and sources.relative_file("/r", "c") == "c"


def test_walking(project):
    put(project, "lib/.gitignore", "*.gen.ts\n!keep.gen.ts\n/only.ts\n")
    for name in ("lib/x.gen.ts", "lib/keep.gen.ts", "lib/only.ts", "lib/sub/only.ts", "dist/a.ts", "lib/mine/b.ts", ".hidden/c.ts", "lib/B.TSX", "lib/huge.js"):
        put(project, name, "x" * (20 if "huge" in name else 1))
    got = sources.walked(str(project), exclude=["mine"], max_bytes=19)
    assert got == ["empty.ts", "lib/B.TSX", "lib/keep.gen.ts", "lib/sub/only.ts"]


def test_configurations():
    assert Config.parse(" openai : text-embedding-3-small ").dimensions == 1536
    assert Config().spec == "openai:text-embedding-3-large"
    for bad in ("openai", "openai:", ":x", "other:x", "openai:nothing"):
        with pytest.raises(ValueError):
            Config.parse(bad)
    with pytest.raises(ValueError, match="dimensions"):
        Config("openai", "text-embedding-3-small", 7)


def test_service_retries_and_keys(tmp_path):
    replies, waits, sent = [], [], []

    def post(url, key, body):
        sent.append(body)
        return replies.pop(0)

    http = Http(Config(), "k", "http://x", post, waits.append)
    replies[:] = [(429, ""), (503, ""), (200, '{"data": [{"embedding": [1.0]}, {"embedding": [2.0]}]}')]
    assert http(["a", "é" * 7000]) == [[1.0], [2.0]] and waits == [0.5, 1.0]
    assert [len(t.encode()) for t in sent[0]["input"]] == [1, 12_000]
    replies[:] = [(500, "")] * 4
    with pytest.raises(RuntimeError, match="500"):
        http(["a"])
    assert not replies
    replies[:] = [(401, "bad"), (200, "")]
    with pytest.raises(KeyRejected):
        http(["a"])
    replies[:] = [(200, '{"data": []}')]
    with pytest.raises(RuntimeError, match="0 vectors"):
        http(["a"])
    bad = RejectedKeys(tmp_path / "cache" / "keys")
    bad.add("k1")
    again = RejectedKeys(tmp_path / "cache" / "keys")
    assert again.choose([("k1", "env"), ("k2", ".env")]) == "k2"
    again.add("k2")
    assert again.choose([("k1", "env"), ("k2", ".env")]) == "k1" and not RejectedKeys(tmp_path / "cache" / "keys").known


def test_the_engine_takes_the_service_that_a_configuration_names(spark, project, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/store")
    for name in ("HOME", "OPENAI_API_KEY"):
        monkeypatch.setenv(name, str(tmp_path / "home")) if name == "HOME" else monkeypatch.delenv(name, raising=False)
    monkeypatch.chdir(tmp_path)
    with pytest.raises(ValueError, match="no key"):  # no vectors under a service's name that it did not make
        e.index(str(project), embedding_spec="openai:text-embedding-3-small")
    assert e.store.read("chunks").count() == 0
    put(project, ".env", "OPENAI_API_KEY=bad\n")
    put(tmp_path, "home/.zshrc", "export OPENAI_API_KEY=good\n")

    def post(url, key, body):
        assert url == embedding.URL and body["model"] == "text-embedding-3-small"
        if key == "bad":
            return 401, "who are you"
        return 200, json.dumps({"data": [{"embedding": [float(len(t))] * body["dimensions"]} for t in body["input"]]})

    def found(config):
        return embedding.provider(config, str(project), tmp_path / "cache", post=post, environ={}, home=str(tmp_path / "home"), cwd=str(tmp_path))

    e = Engine(spark, f"file://{tmp_path}/store", found)
    with pytest.raises(Exception, match="who are you"):
        e.index(str(project), embedding_spec="openai:text-embedding-3-small")
    assert e.index(str(project), embedding_spec="openai:text-embedding-3-small")["added"] == 3  # with the next key
    rows = e.store.read("chunks").collect()
    assert {(r.provider, r.dimensions, len(r.embedding)) for r in rows} == {("openai", 1536, 1536)}
    assert e.search("alpha", str(project)).count() == 3
    assert embedding.provider(Config("hashed", "words-256", 256))()(["a"]) == Hashed(256)(["a"])


def test_a_folder_that_tasks_list(spark, tmp_path):
    for name, data in (("in/a/x.md", "# one\n"), ("in/b.py", "y = 1\n"), ("in/c.bin", "no"), ("in/d.md", b"\xff"), ("in/large.md", "z" * 900)):
        put(tmp_path, name, data)
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.index_folder(f"file://{tmp_path}/in", "p", max_bytes=500) == {"added": 2, "skipped": 1, "updated": 0, "deleted": 0}
    assert {r.source for r in e.store.read("chunks", "p").collect()} == {"a/x.md", "b.py"}


def test_one_changed_file_rewrites_one_bucket(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.store.bucket_bytes = 4096
    schema = "project string, file_path string, content string, size long"

    def files(project, edited=()):
        return spark.createDataFrame([(project, f"f{i}.md", f"# {i}\n" + "text " * 50 + ("!" if i in edited else ""), 260) for i in range(40)], schema)

    assert e.index_table(files("p"), "p")["added"] == 40 and e.index_table(files("q/x [1]"), "q/x [1]")["added"] == 40
    before = e.store.pointers()
    assert before["p"]["n"] > 5 and len(before["p"]["chunks"]) > 5
    assert e.index_table(files("p", {7}), "p") == {"added": 0, "skipped": 39, "updated": 1, "deleted": 1}
    after = e.store.pointers()
    moved = [b for b, v in after["p"]["chunks"].items() if before["p"]["chunks"].get(b) != v]
    assert len(moved) == 1 and after["q/x [1]"] == before["q/x [1]"]
    assert {r.content[-1] for r in e.store.read("chunks", "p").where("source = 'f7.md'").collect()} == {"!"}
    assert e.store.read("chunks").count() == 80 and e.store.read("hashes", "p").count() == 40
    assert e.store.vacuum() > 0 and e.store.read("chunks").count() == 80


def test_of_two_writers_of_one_project_the_later_fails(spark, tmp_path):
    schema = "project string, file_path string, content string, size long"
    rows, other = spark.createDataFrame([("p", "a.md", "# a", 3)], schema), Engine(spark, f"file://{tmp_path}/store")

    def slow(_):
        other.index_table(rows, "p")
        other.index_table(spark.createDataFrame([("q", "a.md", "# a", 3)], schema), "q")
        return lambda: Hashed(256)

    with pytest.raises(Changed):
        Engine(spark, f"file://{tmp_path}/store", slow).index_table(rows, "p", force=True)
    assert other.store.read("chunks").count() == 2


def test_where_keys_are_found(tmp_path):
    put(tmp_path, ".env", "# X=no\n\nX = 'one'\n")
    put(tmp_path, "a/b/.env", 'OTHER=1\nX="two"\n')
    put(tmp_path, "home/.zshrc", "X=not exported\nexport X=three\n")
    put(tmp_path, "home/.bashrc", "export X=two")
    got = embedding.keys("X", str(tmp_path / "a/b"), {"X": "zero"}, str(tmp_path / "home"), str(tmp_path / "a"))
    assert got == [("zero", "environment"), ("two", ".env"), ("one", ".env"), ("three", ".zshrc")]
    assert embedding.key_in("X=\nX=''", "X") is None


def test_vectors_come_in_order(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"word{i}") for i in range(250)], "i int, chunk string").repartition(3)

    def provider():
        hashed = Hashed(16)

        def call(texts):
            assert 0 < len(texts) <= 100
            return hashed(texts)

        return call

    got = {r.i: r.embedding for r in embedding.embedded(df, provider).collect()}
    assert got[3] is None and all(got[i] == pytest.approx(Hashed(16).one(f"word{i}")) for i in got if i != 3)
    assert Hashed(4).one("...") == [0.0] * 4

"""The index's tables on shared storage: a change writes the touched buckets anew, then points to them.

A table is Parquet below v=VERSION/project=PROJECT/bucket=BUCKET, where a bucket is a hash of
the file's path; versions.json names, for each project, the version of each of its buckets.
A run over a project writes the buckets of the files that it changes and nothing else, and
clearing a project writes no table at all.  A project gets a bucket for about BUCKET_BYTES
when it is first written.

Readers keep the buckets that they opened; a job that dies leaves the old ones in place.  Two
writers of different projects don't disturb each other; of two writers of one project the
later one fails.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "projects": "project string, provider string, model string, dimensions int, config_version int, created_at timestamp, updated_at timestamp",
    "chunks": "id string, content string, project string, source string, language string, provider string, model string, dimensions int, chunk_no int, embedding array<float>",
    "hashes": "project string, file_path string, content_hash string, indexed_at timestamp",
}
PATHS = {"chunks": "source", "hashes": "file_path"}
BUCKET_BYTES, LOCK_SECONDS = 256 << 20, 60.0
#: New rows of a bucket are written by so many tasks at most, of so many bytes at least. A run whose buckets have more files than FRAGMENTS each
#: brings their rows together. Keys of files are broadcast up to so many bytes, counted with KEY_BYTES for each.
TASKS, TASK_BYTES, FRAGMENTS, KEYS_BYTES, KEY_BYTES = 8, 16 << 20, 16, 32 << 20, 64


class Changed(RuntimeError):
    """Another writer was faster."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; a local session without one gets its own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessellum-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        conf = "file://" + folder
    return f"{conf.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """projects, chunks and hashes below one folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, place: str, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.spark, self.place, self.bucket_bytes = spark, place.rstrip("/"), bucket_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # what there is

    def pointers(self) -> dict[str, dict]:
        """For each project: buckets, and for each table the version of each bucket."""
        at = self._path(f"{self.place}/versions.json")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _at(self, name: str, project: str, bucket: str, version: str) -> str:
        quoted = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)
        return f"{self.place}/{name}/v={version}/project={quoted}/bucket={bucket}"

    def read(self, name: str, project: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as it is now, of one project or some of its buckets if so asked; empty before the first write."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        own = self.pointers()
        wanted = own if project is None else {project: own[project]} if project in own else {}
        places = [
            self._at(name, p, b, version) for p, x in wanted.items() for b, version in x.get(name, {}).items() if buckets is None or int(b) in buckets
        ]
        if not places:
            return empty
        schema = SCHEMAS[name] + ", v string, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.place}/{name}").parquet(*[_unglobbed(x) for x in places]).select(empty.columns)

    # changes

    def bucket(self, path: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")

    def setup(self) -> None:
        if not self._fs.exists(self._path(f"{self.place}/versions.json")):
            self._point(lambda now: now)

    def put_config(self, project: str, config: DataFrame) -> None:
        """One row, in place of the project's."""
        before = self.pointers().get(project)
        self._replace(project, before, {"projects": self._written("projects", config.withColumn("bucket", F.lit(0)), project, [0])}, (before or {}).get("n", 1))

    def buckets(self, before: dict | None, n_bytes: int) -> int:
        """How many buckets a project has, or gets for so many bytes."""
        return before["n"] if before and before.get("chunks") else max(1, -(-n_bytes // self.bucket_bytes))

    def laid_out(self, files: DataFrame, work: DataFrame, n: int, n_bytes: int) -> DataFrame:
        """files(file_path, ...) by the buckets of their chunks, so that what is made of them is written where it is made; work has their paths."""
        touched = sorted(r[0] for r in work.select(self.bucket(F.col("file_path"), n)).distinct().collect())
        want = min(-(-n_bytes // TASK_BYTES), 4 * self.spark.sparkContext.defaultParallelism)
        k = max(1, min(TASKS, -(-want // max(1, len(touched)))))
        place = F.pmod(F.hash("file_path"), F.lit(k)).cast("int") + self._position(self.bucket(F.col("file_path"), n), touched) * k
        return files.repartitionById(max(1, len(touched)) * k, place)

    @staticmethod
    def _position(bucket: Column, touched: list[int]) -> Column:
        return (F.array_position(F.lit(touched), bucket) - 1).cast("int") if touched else F.lit(0)

    def new_version(self) -> str:
        return uuid.uuid4().hex

    def add(self, name: str, project: str, rows: DataFrame, n: int, version: str) -> str:
        """Writes rows below a version that nothing points to as yet, where they are; the version."""
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows = rows.withColumn("bucket", self.bucket(F.col(PATHS[name]), n))
        rows.select(*[F.col(f.name).cast(f.dataType) for f in columns], "bucket").write.mode("append").partitionBy("project", "bucket").parquet(self.version_path(name, version))
        return version

    def version_path(self, name: str, version: str) -> str:
        return f"{self.place}/{name}/v={version}"

    def added(self, name: str, version: str) -> DataFrame:
        """The rows below a version."""
        schema = SCHEMAS[name] + ", v string, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.place}/{name}").parquet(_unglobbed(self.version_path(name, version)))

    def put(self, project: str, chunks: str, hashes: DataFrame, gone: DataFrame, n: int, config: DataFrame, before: dict | None) -> list[int]:
        """Adds the chunks of a version that add() wrote, and hashes, takes out those of files in gone(file_path, hash_too); the buckets that were written.

        Where hash_too is false the file's hash stays.  before is what pointers() had of the
        project when the run began to look at it.  Rows that stay are copied where they are read, without a
        shuffle, but for those of buckets that have become many small files.
        """
        weight = F.sum(F.octet_length("file_path") + KEY_BYTES)
        keys = {r["bucket"]: r["n"] for r in gone.groupBy(self.bucket(F.col("file_path"), n).alias("bucket")).agg(weight.alias("n")).collect()}
        touched, out = sorted(keys), {}
        brought = self.laid_out(hashes, gone, n, 0)
        for name, version in (("chunks", chunks), ("hashes", self.add("hashes", project, brought, n, self.new_version()))):
            path = PATHS[name]
            out_of = gone.where("hash_too") if name == "hashes" else gone
            for some in _rounds(keys, KEYS_BYTES):
                old = self.read(name, project, some)
                n_files = len(old.inputFiles())
                if not n_files:
                    continue
                taken = out_of.where(self.bucket(F.col("file_path"), n).isin(some)).select(F.col("file_path").alias(path)).distinct()
                kept = old.join(F.broadcast(taken), path, "left_anti").select(old.columns)
                if n_files > FRAGMENTS * len(some):
                    kept = kept.repartitionById(len(some), self._position(self.bucket(F.col(path), n), some))
                self.add(name, project, kept, n, version)
            out[name] = self._versions(name, project, touched, version)
        out["projects"] = self._written("projects", config.withColumn("bucket", F.lit(0)), project, [0])
        self._replace(project, before, out, n)
        return touched

    def clear(self, project: str) -> None:
        """No table is written: nothing points to the project any longer."""

        def without(now: dict) -> dict:
            return {p: x for p, x in now.items() if p != project}

        self._point(without)

    def _written(self, name: str, rows: DataFrame, project: str, buckets: list[int]) -> dict[str, str | None]:
        """The version of each of the buckets; None for one that has no rows left."""
        version = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in columns], "bucket")
        out.repartition(max(1, len(buckets)), "bucket").write.partitionBy("project", "bucket").parquet(f"{self.place}/{name}/v={version}")
        return self._versions(name, project, buckets, version)

    def _versions(self, name: str, project: str, buckets: list[int], version: str) -> dict[str, str | None]:
        return {str(b): version if self._fs.exists(self._path(self._at(name, project, str(b), version))) else None for b in buckets}

    def _replace(self, project: str, before: dict | None, tables: dict[str, dict[str, str | None]], n: int) -> None:
        def merged(now: dict) -> dict:
            if now.get(project) != before:
                raise Changed(f"the index of {project} was changed while this run worked on it")
            own = dict(before or {})
            for name, buckets in tables.items():
                own[name] = {b: v for b, v in {**own.get(name, {}), **buckets}.items() if v is not None}
            return {**now, project: {**own, "n": n}}

        self._point(merged)

    def _point(self, change) -> None:  # noqa: ANN001
        """Replaces the pointers by change(pointers); one writer at a time, by a file that only one can create."""
        lock, until = self._path(f"{self.place}/versions.lock"), time.monotonic() + LOCK_SECONDS
        while True:
            try:
                self._fs.create(lock, False).close()
                break
            except Py4JJavaError as e:
                if time.monotonic() > until:
                    raise RuntimeError(f"{self.place}/versions.lock is held by another writer; delete it if that one is dead") from e
                time.sleep(0.1)
        try:
            self._save(change(self.pointers()))
        finally:
            self._fs.delete(lock, False)

    def _save(self, versions: dict) -> None:
        part, at = self._path(f"{self.place}/versions-{uuid.uuid4().hex}.json"), self._path(f"{self.place}/versions.json")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(versions).encode()))
        finally:
            out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(at), kinds)

    def stage_path(self) -> str:
        return f"{self.place}/staged/{uuid.uuid4().hex}"

    def discard(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def vacuum(self) -> int:
        """Deletes buckets that nothing points to, and what runs that died have staged; no reader of old buckets and no writer may be at work."""
        now, gone = self.pointers(), 0
        self.discard(f"{self.place}/staged")
        for name in SCHEMAS:
            top = self._path(f"{self.place}/{name}")
            used = {self._path(self._at(name, p, b, v)).toUri().getPath() for p, x in now.items() for b, v in x.get(name, {}).items()}
            if not self._fs.exists(top):
                continue
            for version in self._fs.listStatus(top):
                buckets = [b.getPath() for p in self._fs.listStatus(version.getPath()) if p.isDirectory() for b in self._fs.listStatus(p.getPath())]
                old = [b for b in buckets if b.toUri().getPath() not in used]
                for b in old:
                    self._fs.delete(b, True)
                gone += len(old)
                if len(old) == len(buckets):
                    self._fs.delete(version.getPath(), True)
        return gone


def _unglobbed(place: str) -> str:
    """A path in which no sign means many."""
    return "".join("\\" + c if c in "[]{}*?\\" else c for c in place)


def _rounds(weights: dict[int, int], most: int) -> list[list[int]]:
    """The keys in order, in runs of that weight at most, or one."""
    out, held = [], most + 1
    for key in sorted(weights):
        if held + weights[key] > most:
            out.append([])
            held = 0
        out[-1].append(key)
        held += weights[key]
    return out

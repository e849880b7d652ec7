"""All that the engine does for a user, as methods: index, search, status, tree, scan and the rest."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import paths
from tessellum.operators import chunking, embedding, search, state, tree
from tessellum.operators.embedding import Config
from tessellum.sources import files as sources
from tessellum.sources.store import KEY_BYTES, KEYS_BYTES, Store
from tessellum.structure import scan as scans

Provider = Callable[[Sequence[str]], list[list[float]]]
ENVIRONMENT = "TESSELLUM_EMBEDDING"
#: What a project gets that names nothing else: vectors that need no service, under their own name.
LOCAL = Config("hashed", "words-256", 256)


class Engine:
    """Works on the tables below `place`; providers gives, for a configuration, what makes its provider."""

    def __init__(self, spark: SparkSession, place: str, providers: Callable[[Config], Callable[[], Provider]] | None = None, default: Config | None = None) -> None:
        self.spark, self.store, self.default = spark, Store(spark, place), default or LOCAL
        self._providers = providers

    # configuration

    def setup(self) -> None:
        """Makes the index where there is none."""
        self.store.setup()

    def _provider(self, config: Config, root: str | None) -> Callable[[], Provider]:
        return self._providers(config) if self._providers else embedding.provider(config, root)

    def _named(self, project: str) -> DataFrame:
        return self.spark.createDataFrame([(project,)], "project string")

    def config(self, project: str) -> tuple[Config, str]:
        """The project's configuration, and where it comes from: stored, inferred or default."""
        d = self.default
        row = state.resolved_config(self._named(project), self.store.read("projects", project), self.store.read("chunks", project), (d.provider, d.model, d.dimensions)).first()
        return Config(row["provider"], row["model"], row["dimensions"]), row["origin"]

    def has_data(self, project: str) -> bool:
        own = self.store.pointers().get(project, {})
        return bool(own.get("chunks") or own.get("hashes"))

    def _resolved(self, project: str) -> Config:
        """config(); what was inferred, or serves data that is there, is stored."""
        config, origin = self.config(project)
        if origin == "inferred" or (origin == "default" and self.has_data(project)):
            self.store.put_config(project, self._with_project(project, config))
        return config

    def _for_index(self, project: str, spec: str | None) -> Config:
        if spec is not None:
            wanted = Config.parse(spec)
            if self.config(project)[1] == "stored" or self.has_data(project):
                now = self._resolved(project)
                if now != wanted:
                    raise ValueError(f"{project} is indexed with {now.spec}, not {wanted.spec}; reindex to change that")
            return wanted
        config, origin = self.config(project)
        if origin == "stored":
            return config
        if self.has_data(project):
            return self._resolved(project)
        given = os.environ.get(ENVIRONMENT, "").strip()
        return Config.parse(given) if given else config

    def _with_project(self, project: str, c: Config) -> DataFrame:
        now = F.current_timestamp()
        new = self._named(project).select(
            "project", F.lit(c.provider).alias("provider"), F.lit(c.model).alias("model"), F.lit(c.dimensions).alias("dimensions"),
            F.lit(1).alias("config_version"), now.alias("created_at"), now.alias("updated_at"),
        )
        return state.upserted(self.store.read("projects", project), new, ["project"], keep=["created_at", "config_version"])

    # indexing

    def index(
        self,
        root: str = ".",
        embedding_spec: str | None = None,
        file: str | None = None,
        ignore_file: str | None = None,
        force: bool = False,
        chunk_size: int = chunking.SIZE,
        chunk_overlap: int = chunking.OVERLAP,
        max_bytes: int = state.MAX_BYTES,
    ) -> dict[str, int]:
        """Brings a git project's index up to date; added, skipped, updated, deleted."""
        top = str(Path(root).resolve(strict=True))
        project = sources.project_id(top)
        names = [sources.relative_file(top, file)] if file is not None else sources.git_files(top, ignore_file)
        table = sources.contents(self.spark, top, names, project, max_bytes)
        return self.index_table(table, project, embedding_spec, force, file is not None, chunk_size, chunk_overlap, max_bytes, top)

    def index_folder(self, place: str, project: str, **how: object) -> dict[str, int]:
        """The same for a folder of any file system, which tasks list and read; nothing of it passes through the driver."""
        return self.index_table(sources.folder(self.spark, place, project, how.get("max_bytes", state.MAX_BYTES)), project, **how)

    def index_table(
        self,
        table: DataFrame,
        project: str,
        embedding_spec: str | None = None,
        force: bool = False,
        single: bool = False,
        chunk_size: int = chunking.SIZE,
        chunk_overlap: int = chunking.OVERLAP,
        max_bytes: int = state.MAX_BYTES,
        root: str | None = None,
    ) -> dict[str, int]:
        """The same for files(project, file_path, content, size) from anywhere; root is where keys of services are looked for.

        Contents are read to be hashed, and those of changed files once more to be split; what is
        joined in between are paths and hashes.  Contents go to where the chunks are written, so that vectors, which are
        larger, are written once and never shuffled.  They are made before anything is changed, and all tables
        change at once: a failure leaves the index as it was.
        """
        config = self._for_index(project, embedding_spec)
        before = self.store.pointers().get(project)
        provider, staged = self._provider(config, root), [self.store.stage_path() for _ in range(2)]
        hashes, version = self.store.read("hashes", project), None
        try:
            measured = table.withColumn("n_bytes", F.octet_length("content").cast("long"))
            statuses = self._staged(state.classified(measured, hashes, force or single, max_bytes).drop("content"), staged[0])
            work = statuses.where("status = 'changed'").select(*state.KEY, "content_hash", "n_bytes")
            swept = state.deleted(table, hashes) if force and not single else None
            total = work.agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"), F.sum(F.octet_length("file_path") + KEY_BYTES).alias("keys")).first()
            if not total["files"]:
                return self._counts(state.counters(statuses, work, self.store.read("chunks", project)).first())
            n_chunks = total["files"] + total["bytes"] // max(1, chunk_size - chunk_overlap, chunk_size // 2)
            size = total["bytes"] + 4 * config.dimensions * n_chunks
            n = self.store.buckets(before, size)
            files = table.select(*state.KEY, "content", "size")
            if force or single or not (before and before.get("hashes")):
                files = files.where(F.col("content").isNotNull() & F.coalesce(F.col("size") <= max_bytes, F.lit(True)))
            else:
                keys = work.select(*state.KEY).distinct()
                files = files.join(F.broadcast(keys) if total["keys"] <= KEYS_BYTES else keys, state.KEY, "left_semi")
            rows = chunking.chunked(self.store.laid_out(files.drop("size"), work, n, size), chunk_size, chunk_overlap)
            rows = embedding.embedded(rows, provider).select(
                F.concat("project", F.lit("/"), "file_path", F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 9, "0")).alias("id"),
                F.col("chunk").alias("content"), "project", F.col("file_path").alias("source"), paths.language(F.col("file_path")).alias("language"),
                F.lit(config.provider).alias("provider"), F.lit(config.model).alias("model"), F.lit(config.dimensions).alias("dimensions"), "chunk_no", "embedding",
            )
            version = self.store.new_version()
            try:
                self.store.add("chunks", project, rows, n, version)
            except Exception as e:
                if embedding.KeyRejected.__name__ in str(e):
                    provider.refused()
                raise
            split = self.store.added("chunks", version).select("project", F.col("source").alias("file_path")).distinct()
            done = work.drop("n_bytes").join(split, state.KEY, "left_semi").distinct().withColumn("hash_too", F.lit(True))
            gone = done
            if swept is not None:  # their hashes stay
                gone = gone.unionByName(swept.select(*state.KEY, F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("hash_too")))
            gone = self._staged(gone, staged[1])
            done = gone.where("hash_too")
            if done.isEmpty():
                return self._counts(state.counters(statuses, done, self.store.read("chunks", project)).first())
            counted = state.counters(statuses, done, self.store.read("chunks", project), swept).first()
            new = done.select(*state.KEY, "content_hash", F.current_timestamp().alias("indexed_at"))
            self.store.put(project, version, new, gone.select("file_path", "hash_too"), n, self._with_project(project, config), before)
            version = None
            return self._counts(counted)
        finally:
            for path in [*staged, *([self.store.version_path("chunks", version)] if version else [])]:
                self.store.discard(path)

    @staticmethod
    def _counts(row: Row | None) -> dict[str, int]:
        return {k: int(row[k] or 0) if row else 0 for k in ("added", "skipped", "updated", "deleted")}

    def _staged(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def reindex(self, root: str = ".", **how: object) -> dict[str, int]:
        """Clears the project, its configuration too, then indexes it anew."""
        self.clear(root)
        return self.index(root, **{**how, "force": True})

    def clear(self, root: str = ".") -> int:
        """Takes a project out of all tables; the number of its chunks."""
        project = sources.project_id(str(Path(root).resolve(strict=True)))
        n = self.store.read("chunks", project).count()
        self.store.clear(project)
        return n

    # questions

    def search(self, words: str | Sequence[str], root: str = ".", limit: int = search.LIMIT, threshold: float = search.THRESHOLD, language: str | None = None) -> DataFrame:
        """The nearest chunks; operators.search renders them as JSON, files or snippets."""
        text = search.query_text([words] if isinstance(words, str) else words)
        project = sources.project_id(str(Path(root).resolve(strict=True)))
        provider = self._provider(self._resolved(project), root)
        try:
            vector = provider()([text])[0]
        except embedding.KeyRejected:
            provider.refused()
            raise
        return search.similar(self.store.read("chunks", project), vector, limit, threshold, language, project)

    def _now(self, root: str) -> tuple[str, DataFrame]:
        top = str(Path(root).resolve(strict=True))
        project = sources.project_id(top)
        return project, sources.contents(self.spark, top, sources.git_files(top), project)

    def stale(self, root: str = ".") -> int:
        """How many files a search warns of; 0 if it can't be told."""
        try:
            project, now = self._now(root)
            rows = state.stale_count(now, self.store.read("hashes", project)).collect()
        except (OSError, ValueError):
            return 0
        return int(rows[0]["n_stale"]) if rows else 0

    def status(self, root: str = ".") -> str:
        project, now = self._now(root)
        c = self._resolved(project)
        config = self._named(project).select("project", F.lit(c.provider).alias("provider"), F.lit(c.model).alias("model"), F.lit(c.dimensions).alias("dimensions"))
        r = state.status_lines(now, self.store.read("hashes", project), self.store.read("chunks", project), config).first()
        warn = " ⚠ run `index` to update" if r["n_stale"] else ""
        lines = [f"Project : {project}", f"Files   : {r['files']}", f"Chunks  : {r['chunks']}", f"Embed   : {r['embedding']}", f"Stale   : {r['n_stale']}{warn}"]
        lines += [f"  • {p}" for p in r["paths"]] + ([f"  ... and {r['more']} more"] if r["more"] else [])
        return "\n".join(lines) + "\n"

    def projects(self) -> DataFrame:
        return state.project_list(self.store.read("projects"), self.store.read("chunks"))

    def list(self) -> str:
        rows = state.list_report(self.projects()).collect()
        return "\n".join(r["report"] for r in rows) + "\n" if rows else "No indexed projects.\n"

    def tree(self, root: str = ".", path: str = "", depth: int = tree.DEPTH, inline: int = tree.INLINE, everything: bool = False) -> str:
        folders, names = sources.tree_entries(root, path, everything)
        files = self.spark.createDataFrame([(n,) for n in names], "file_path string")
        return tree.outline(files, path, depth, inline, everything, folders)

    def scan(self, root: str = ".", include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = scans.MAX_BYTES, kinds: str = "all", file: str | None = None) -> DataFrame:
        """Functions, bindings and exports of each file; structure.scan has the views and renderings."""
        top = str(Path(root).resolve(strict=True))
        names = [file] if file is not None else sources.walked(top, include, exclude, max_bytes)
        table = sources.contents(self.spark, top, names, top).select(F.col("file_path").alias("path"), "content", "size")
        return scans.scanned(table, kinds)


"""The state of an index: what changed, what is stale, and the tables after a run.

Every operator takes whole tables and gives whole tables: look-ups of single files are
joins on (project, file_path), and a change is a new table, never an update in place.

    files     project, file_path, content, size
    hashes    project, file_path, content_hash, indexed_at
    chunks    id, content, project, source, language, provider, model, dimensions, embedding
    projects  project, provider, model, dimensions, config_version, created_at, updated_at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import text as tx

KEY = ["project", "file_path"]
MAX_BYTES, SHOWN, SALTS = 524_288, 20, 64


def hashed(files: DataFrame) -> DataFrame:
    """files with content_hash; those that can't be read (null content) are gone."""
    return files.where("content is not null").withColumn("content_hash", tx.content_hash(F.col("content")))


def classified(files: DataFrame, hashes: DataFrame, force: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files with content_hash and status: oversized, unreadable, unchanged or changed."""
    stored = hashes.select(*KEY, F.col("content_hash").alias("stored_hash"))
    # no status asks for the content itself, so that it need not go through the join
    now = files.withColumn("content_hash", tx.content_hash(F.col("content")))
    same = F.lit(False) if force else F.col("stored_hash").eqNullSafe(F.col("content_hash"))
    status = (
        F.when(F.col("size") > max_bytes, "oversized").when(F.col("content_hash").isNull(), "unreadable").when(same, "unchanged").otherwise("changed")
    )
    return now.join(stored, KEY, "left").withColumn("status", status).drop("stored_hash")


def changed(files: DataFrame, hashes: DataFrame, force: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files that need work, with their hashes: an anti join on path and hash."""
    small = hashed(files.where(~F.coalesce(F.col("size") > max_bytes, F.lit(False))))
    return small if force else small.join(hashes.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti")


def stale(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(project, file_path, reason) of what differs between disk and index: new, changed or deleted.

    A file that can't be read is neither stale nor deleted; sizes don't matter here.
    """
    now = files.select(*KEY, F.lit(True).alias("here"), tx.content_hash(F.col("content")).alias("now"))
    then = hashes.select(*KEY, F.lit(True).alias("known"), F.col("content_hash").alias("then"))
    both = now.join(then, KEY, "full_outer")
    reason = (
        F.when(F.col("here").isNull(), "deleted")
        .when(F.col("now").isNull(), None)
        .when(F.col("known").isNull(), "new")
        .when(~F.col("now").eqNullSafe(F.col("then")), "changed")
    )
    return both.select(*KEY, reason.alias("reason")).where("reason is not null")


def stale_count(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(project, n_stale) as a search warns of it: projects without any hash count none."""
    known = hashes.select("project").distinct()
    counts = stale(files, hashes).groupBy("project").agg(F.count("*").alias("n"))
    return known.join(counts, "project", "left").select("project", F.coalesce("n", F.lit(0)).alias("n_stale"))


def stale_report(files: DataFrame, hashes: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(project, n_stale, paths, more): the first paths of each project, and how many others there are."""
    # one pass, salted: a project may have most of the files, and a task keeps no more than `shown` paths of a salt
    salted = stale(files, hashes).withColumn("salt", F.pmod(F.xxhash64("file_path"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("project", "salt").orderBy("file_path"))
    first = F.collect_list(F.when(F.col("rank") <= shown, F.col("file_path"))).alias("paths")
    parts = salted.withColumn("rank", rank).groupBy("project", "salt").agg(F.max("rank").cast("long").alias("n"), first)
    whole = parts.groupBy("project").agg(F.sum("n").alias("n_stale"), F.slice(F.sort_array(F.flatten(F.collect_list("paths"))), 1, shown).alias("paths"))
    return whole.select("project", "n_stale", "paths", F.greatest(F.col("n_stale") - shown, F.lit(0)).alias("more"))


def deleted(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """(project, file_path) of stored files that are gone."""
    return hashes.select(*KEY).join(files.select(*KEY), KEY, "left_anti")


def project_counts(chunks: DataFrame) -> DataFrame:
    """(project, chunks, files), both exact."""
    return chunks.groupBy("project").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"))


def project_list(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project, chunks, files, embedding, updated), the last updated first, with 0 for projects without chunks."""
    embedding = F.when(
        F.col("provider").isNotNull() & F.col("model").isNotNull() & F.col("dimensions").isNotNull(),
        F.concat("provider", F.lit(":"), "model", F.lit(" ("), F.col("dimensions").cast("string"), F.lit("d)")),
    )
    return (
        projects.join(project_counts(chunks), "project", "left")
        .orderBy(F.desc("updated_at"), "project")
        .select(
            "project",
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("files", F.lit(0)).alias("files"),
            embedding.alias("embedding"),
            F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"),
        )
    )


def list_report(listed: DataFrame) -> DataFrame:
    """(project, report): two lines for each project."""
    line = F.format_string(
        "  Files: %d  Chunks: %d  Embed: %s  Updated: %s", "files", "chunks", F.coalesce("embedding", F.lit("unknown")), F.coalesce("updated", F.lit("—"))
    )
    return listed.select("project", F.concat_ws("\n", "project", line).alias("report"))


def counters(statuses: DataFrame, chunked: DataFrame, chunks: DataFrame, swept: DataFrame | None = None) -> DataFrame:
    """(project, added, skipped, updated, deleted) of a run.

    statuses comes from classified(); chunked has the (project, file_path) that gave chunks
    and are written.  A file whose old chunks are removed is updated, another one added;
    deleted counts the removed chunks, those of swept files among them.
    """
    old = chunks.groupBy("project", F.col("source").alias("file_path")).agg(F.count("*").alias("n_old"))
    files = chunked.select(*KEY).distinct().withColumn("what", F.lit("w"))
    if swept is not None:
        files = files.unionByName(swept.select(*KEY, F.lit("d").alias("what")))
    # the old chunks are counted and joined once, whatever becomes of them
    rows = files.join(old, KEY, "left").where("what = 'w' or n_old > 0").select("project", F.coalesce("n_old", F.lit(0)).alias("n"), "what")
    skipped = statuses.where(F.col("status").isin("oversized", "unchanged")).select("project", F.lit(0).cast("long").alias("n"), F.lit("s").alias("what"))
    rows = rows.unionByName(skipped)
    return rows.groupBy("project").agg(
        F.count_if((F.col("what") == "w") & (F.col("n") == 0)).alias("added"),
        F.count_if(F.col("what") == "s").alias("skipped"),
        F.count_if((F.col("what") == "w") & (F.col("n") > 0)).alias("updated"),
        F.sum("n").alias("deleted"),
    )


def without_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks but those of the files in gone(project, file_path)."""
    return chunks.join(gone.select("project", F.col("file_path").alias("source")).distinct(), ["project", "source"], "left_anti").select(chunks.columns)


def removed_count(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """(project, file_path, removed): how many chunks each of these files loses."""
    own = chunks.select("project", F.col("source").alias("file_path"))
    return own.join(gone.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("removed"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same key; keep names columns that stay as they were."""
    if keep:
        before = old.select(*key, *[F.col(c).alias(f"__{c}") for c in keep])
        joined = new.join(before, key, "left")
        new = joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(*key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def cleared(table: DataFrame, project: str) -> DataFrame:
    return table.where(~F.col("project").eqNullSafe(F.lit(project)))


def inferred_config(chunks: DataFrame) -> DataFrame:
    """(project, provider, model, dimensions) of the first chunk, by id, that has all three."""
    parts = F.struct("provider", "model", "dimensions")
    known = chunks.where("provider is not null and model is not null and dimensions is not null")
    return known.groupBy("project").agg(F.min_by(parts, "id").alias("c")).select("project", "c.*")


def resolved_config(names: DataFrame, projects: DataFrame, chunks: DataFrame, default: tuple[str, str, int]) -> DataFrame:
    """The configuration of each project in names: stored, or inferred from its chunks, or the default; and which."""
    want = ["provider", "model", "dimensions"]
    stored = projects.select("project", F.struct(*want).alias("stored"))
    inferred = inferred_config(chunks).select("project", F.struct(*want).alias("inferred"))
    fallback = F.struct(F.lit(default[0]).alias("provider"), F.lit(default[1]).alias("model"), F.lit(default[2]).cast("int").alias("dimensions"))
    origin = F.when(F.col("stored").isNotNull(), "stored").when(F.col("inferred").isNotNull(), "inferred").otherwise("default")
    rows = names.select("project").distinct().join(stored, "project", "left").join(inferred, "project", "left")
    rows = rows.select("project", F.coalesce("stored", "inferred", fallback).alias("c"), origin.alias("origin"))
    return rows.select("project", "c.provider", "c.model", "c.dimensions", "origin")


def indexed(projects: DataFrame, chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """(project, has_data): chunks or hashes are there."""
    some = chunks.select("project").unionByName(hashes.select("project")).distinct().withColumn("has_data", F.lit(True))
    return projects.select("project").distinct().join(some, "project", "left").select("project", F.coalesce("has_data", F.lit(False)).alias("has_data"))


def status_lines(files: DataFrame, hashes: DataFrame, chunks: DataFrame, config: DataFrame) -> DataFrame:
    """(project, files, chunks, embedding, n_stale, paths, more) of each project in config."""
    return (
        config.select("project", F.concat("provider", F.lit(":"), "model", F.lit(" ("), F.col("dimensions").cast("string"), F.lit("d)")).alias("embedding"))
        .join(project_counts(chunks), "project", "left")
        .join(stale_report(files, hashes), "project", "left")
        .select(
            "project",
            _zero("files"),
            _zero("chunks"),
            "embedding",
            _zero("n_stale"),
            F.coalesce("paths", F.array().cast("array<string>")).alias("paths"),
            _zero("more"),
        )
    )


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("long").alias(name)

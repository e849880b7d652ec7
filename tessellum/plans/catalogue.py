"""Queries over the reference's own operators, by name, and the SQL that gives the same rows.

They run over the driver's tables through one view of a corpus: a document is a file of the
project `source`, its path ends in one of the indexable extensions, embeddings are the
vectors of the files' chunks.  The index's old state holds what `labels` and `pages` name:
labelled documents, toxic ones with another content, and pages, which are gone by now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import paths, vectors
from tessellum.functions import text as tx
from tessellum.operators import chunking, search, state, tree
from tessellum.plans import snippets
from tessellum.structure import nesting, scan

MODEL, DIMENSIONS = "text-embedding-3-large", 2000
FALLBACK = ("openai", "text-embedding-3-small", 1536)
_EXTS = paths.INDEXABLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(project: Column, doc_id: Column) -> Column:
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.pmod(doc_id, F.lit(len(_EXTS))) + 1).cast("int"))
    return F.concat(F.lit("src/"), project, F.lit("/"), F.col("lang"), F.lit("/doc"), doc_id.cast("string"), F.lit("."), ext)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files: project, file_path, content, size, doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("project"), path_of(F.col("source"), F.col("doc_id")).alias("file_path"), F.col("text").alias("content"), F.octet_length("text").alias("size"), "doc_id"
    )


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    return e.join(f, e["vec_id"] == f["doc_id"]).select(
        F.col("vec_id").alias("id"),
        "content",
        "project",
        F.col("file_path").alias("source"),
        paths.language(F.col("file_path")).alias("language"),
        F.when(F.col("label") > 0, "openai").alias("provider"),
        F.lit(MODEL).alias("model"),
        F.lit(DIMENSIONS).alias("dimensions"),
        "embedding",
    )


def hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of an earlier run."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    old = F.when(F.col("toxic") == 1, F.concat("content", F.lit("~"))).otherwise(F.col("content"))
    known = corpus(spark, sf_dir).join(marks, "doc_id").select("project", "file_path", tx.content_hash(old).alias("content_hash"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("project"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_path"), tx.content_hash(F.col("html")).alias("content_hash")
    )
    return known.unionByName(pages)


def project_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project")).agg(F.max("doc_id").alias("m"), F.min("doc_id").alias("n"))
    pages = spark.createDataFrame([("pages", 0, 0)], "project string, m long, n long")
    return d.unionByName(pages).select(
        "project",
        F.when(F.col("m") > 0, "openai").alias("provider"),
        F.lit(MODEL).alias("model"),
        F.lit(DIMENSIONS).alias("dimensions"),
        F.lit(1).alias("config_version"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("n") * 61).alias("created_at"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("m") * 61).alias("updated_at"),
    )


#: The same views for SQL.
_PATH = "concat('src/', source, '/', lang, '/doc', doc_id, '.', ([" + ", ".join(f"'{e}'" for e in _EXTS) + f"])[doc_id % {len(_EXTS)} + 1])"
_LANG = "CASE {p} " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in paths.LANGUAGES.items()) + " ELSE '' END"


def _language(path: str) -> str:
    return _LANG.format(p=f"regexp_extract({path}, '([^.]*)$', 1)")


VIEWS = {
    "files": f"SELECT source AS project, {_PATH} AS file_path, text AS content, strlen(text) AS size, doc_id FROM documents",
    "chunks": f"""SELECT vec_id AS id, content, project, file_path AS source, {_language('file_path')} AS language,
  CASE WHEN label > 0 THEN 'openai' END AS provider, '{MODEL}' AS model, {DIMENSIONS} AS dimensions, embedding
  FROM embeddings JOIN files ON vec_id = doc_id""",
    "hashes": """SELECT project, file_path, sha256(CASE WHEN toxic = 1 THEN content || '~' ELSE content END) AS content_hash
  FROM files JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
  UNION ALL SELECT 'pages', concat('pages/', page_id, '.md'), sha256(html) FROM pages""",
    "projects": f"""SELECT project, CASE WHEN m > 0 THEN 'openai' END AS provider, '{MODEL}' AS model, {DIMENSIONS} AS dimensions,
  make_timestamp((1600000000 + n * 61) * 1000000) AS created_at, make_timestamp((1600000000 + m * 61) * 1000000) AS updated_at
  FROM (SELECT source AS project, max(doc_id) AS m, min(doc_id) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'pages', 0, 0)""",
}
_NEEDS = {"files": [], "chunks": ["files"], "hashes": ["files"], "projects": []}


def _with(names: str, body: str, recursive: bool = False) -> str:
    want: list[str] = []
    for n in names.split():
        want += [x for x in [*_NEEDS[n], n] if x not in want]
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in want)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# search

QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_Q = "[" + ", ".join(map(repr, QUERY_VECTOR)) + "]::DOUBLE[]"
_COSINE = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"
_TOP = f"SELECT id, content, source, language, {_COSINE} AS score FROM chunks {{where}} ORDER BY 1 - score, id LIMIT {{limit}}"


def _found(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    return search.similar(chunk_store(spark, sf_dir), QUERY_VECTOR, **how)


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


@query(_with("chunks", "SELECT id, content, source, language, round(score, 6) AS score FROM (" + _TOP.format(where="WHERE language = 'typescript'", limit=25) + ") WHERE NOT score < 0.05"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_found(spark, sf_dir, limit=25, threshold=0.05, language="tsx"))


@query(_with("chunks", "SELECT id, content, source, language, round(score, 6) AS score FROM (" + _TOP.format(where="", limit=10) + ") WHERE NOT score < 0"))
def vector_topk_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_found(spark, sf_dir))


@query(_with("chunks files", "SELECT id, content, source, language, round(score, 6) AS score FROM (" + _TOP.format(where="WHERE project = (SELECT min(project) FROM files)", limit=10) + ") WHERE NOT score < 0.1"))
def vector_topk_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = corpus(spark, sf_dir).agg(F.min("project")).first()[0]
    return _rounded(_found(spark, sf_dir, threshold=0.1, project=first))


@query(_with("chunks", f"SELECT id, project, language, round({_COSINE}, 6) AS score FROM chunks"))
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every chunk."""
    score = vectors.cosine(vectors.doubles(F.col("embedding")), F.array(*[F.lit(x) for x in QUERY_VECTOR]))
    return chunk_store(spark, sf_dir).select("id", "project", "language", F.round(score, 6).alias("score"))


@query(_with("chunks", "SELECT source AS file, language, round(score, 3) AS score, content FROM (" + _TOP.format(where="", limit=40) + ") WHERE NOT score < 0"))
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.as_json(_found(spark, sf_dir, limit=40))


_PERCENT = "format('{{:.1f}}%', {0} * 100)"


@query(_with("chunks", f"SELECT source, round(best, 6) AS best, concat(source, '  (', {_PERCENT.format('best')}, ')') AS line FROM (SELECT source, greatest(max(score), 0) AS best FROM (" + _TOP.format(where="", limit=400) + ") WHERE NOT score < -1 GROUP BY 1)"))
def search_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_of_files(_found(spark, sf_dir, limit=400, threshold=-1.0)).withColumn("best", F.round("best", 6))


@query("SELECT vec_id, list_resize(embedding, 2000, 0::FLOAT) AS padded FROM embeddings")
def pad_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.padded(F.col("embedding")).alias("padded"))


# paths and hashes


@query(
    _with("files", f"SELECT file_path, regexp_extract(file_path, '([^.]*)$', 1) AS ext, {_language('file_path')} AS language, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder FROM files")
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return corpus(spark, sf_dir).select("file_path", paths.extension(p).alias("ext"), paths.language(p).alias("language"), paths.parent_dir(p).alias("folder"))


_IN = ", ".join(f"'{e}'" for e in _EXTS)


@query(f"SELECT url, regexp_extract(url, '([^.]*)$', 1) IN ({_IN}) AS indexable FROM pages UNION ALL SELECT props, regexp_extract(props, '([^.]*)$', 1) IN ({_IN}) FROM events")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "pages").select("url"), table(spark, sf_dir, "events").select(F.col("props").alias("url"))
    return a.unionByName(b).select("url", paths.is_indexable(F.col("url")).alias("indexable"))


@query(_with("files", "SELECT file_path, sha256(content) AS content_hash, size::INTEGER AS size, ceil(size / 4)::BIGINT AS tokens FROM files"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("file_path", tx.content_hash(F.col("content")).alias("content_hash"), "size", tx.token_estimate(F.col("size")).alias("tokens"))


# chunks


def _plain_sql(size: int, overlap: int) -> str:
    back = overlap // chunking.LINE_BYTES
    return f"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_replace(text, '\\r\\n', chr(10), 'g') AS t FROM documents
), raw AS (
  SELECT doc_id, CASE WHEN t = '' OR t[-1] = chr(10) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS rows FROM texts
), lined AS (
  SELECT doc_id, unnest(rows) AS line, generate_subscripts(rows, 1) - 1 AS k FROM raw WHERE len(rows) > 0
), summed AS (
  SELECT doc_id, k, line, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM lined
), docs AS (
  SELECT doc_id, list_prepend(0, list(upto ORDER BY k)) AS c, list(line ORDER BY k) AS rows FROM summed GROUP BY doc_id
), win AS (
  SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS s, greatest(1, len(list_filter(c[2:], lambda x: x - 1 < {size})))::BIGINT AS e FROM docs
  UNION ALL
  SELECT doc_id, n + 1, b, greatest(b + 1, len(list_filter(c[2:], lambda x: x - 1 - c[b + 1] < {size})))::BIGINT
  FROM (SELECT w.doc_id, w.n, d.c, CASE WHEN (CASE WHEN w.e > {back} THEN w.e - {back} ELSE w.e END) <= w.s THEN w.e ELSE (CASE WHEN w.e > {back} THEN w.e - {back} ELSE w.e END) END AS b
    FROM win w JOIN docs d USING (doc_id))
  WHERE b < len(c) - 1
), texts2 AS (
  SELECT w.doc_id, w.n, array_to_string(d.rows[w.s + 1 : w.e], chr(10)) AS chunk FROM win w JOIN docs d USING (doc_id)
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS chunk_no, chunk FROM texts2 WHERE regexp_matches(chunk, '[^\\s]')"""


def _chunks(df: DataFrame, chunks: Column) -> DataFrame:
    return chunking.exploded(df, chunks).select("doc_id", "chunk_no", "chunk")


@query(_plain_sql(1000, 100))
def chunk_plain_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(corpus(spark, sf_dir), chunking.plain_chunks(F.col("content")))


@query(_plain_sql(400, 0))
def chunk_plain_zero_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(corpus(spark, sf_dir), chunking.plain_chunks(F.col("content"), 400, 0))


@query()
def chunk_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus(spark, sf_dir)
    return _chunks(f, chunking.split_chunks(F.col("content"), F.col("file_path")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, {snippets.sql_text(c)})" for n, cs in snippets.CODE_CHUNKS.items() for i, c in enumerate(cs)) + ") t(file_path, chunk_no, chunk)")
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(snippets.code_files(spark), 40, 0)


# the state of an index


@query(_with("files hashes", "SELECT project, file_path, sha256(content) AS content_hash FROM files f WHERE size <= 524288 AND NOT EXISTS (SELECT 1 FROM hashes h WHERE h.project = f.project AND h.file_path = f.file_path AND h.content_hash = sha256(f.content))"))
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changed(corpus(spark, sf_dir), hash_store(spark, sf_dir)).select("project", "file_path", "content_hash")


_STALE = """SELECT coalesce(f.project, h.project) AS project, coalesce(f.file_path, h.file_path) AS file_path,
  CASE WHEN f.file_path IS NULL THEN 'deleted' WHEN h.file_path IS NULL THEN 'new' ELSE 'changed' END AS reason
  FROM files f FULL JOIN hashes h ON f.project = h.project AND f.file_path = h.file_path
  WHERE f.file_path IS NULL OR h.file_path IS NULL OR sha256(f.content) <> h.content_hash"""


@query(_with("files hashes", _STALE))
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stale(corpus(spark, sf_dir), hash_store(spark, sf_dir))


@query(_with("files hashes", f"+s AS ({_STALE}) SELECT project, count(s.project) AS n_stale FROM (SELECT DISTINCT project FROM hashes) h LEFT JOIN s USING (project) GROUP BY project"))
def stale_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stale_count(corpus(spark, sf_dir), hash_store(spark, sf_dir))


@query(_with("files hashes", f"+s AS ({_STALE}) SELECT project, count(*) AS n_stale, list_sort(list(file_path))[:20] AS paths, greatest(count(*) - 20, 0) AS more FROM s GROUP BY project"))
def stale_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stale_report(corpus(spark, sf_dir), hash_store(spark, sf_dir))


@query(_with("files hashes", "SELECT project, file_path FROM hashes EXCEPT SELECT project, file_path FROM files"))
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.deleted(corpus(spark, sf_dir), hash_store(spark, sf_dir))


@query(_with("chunks", "SELECT project, count(*) AS chunks, count(DISTINCT source) AS files FROM chunks GROUP BY 1"))
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.project_counts(chunk_store(spark, sf_dir))


_LIST = """SELECT p.project, coalesce(c.chunks, 0) AS chunks, coalesce(c.files, 0) AS files,
  CASE WHEN provider IS NOT NULL THEN concat(provider, ':', model, ' (', dimensions, 'd)') END AS embedding, strftime(updated_at, '%Y-%m-%d %H:%M') AS updated
  FROM projects p LEFT JOIN (SELECT project, count(*) AS chunks, count(DISTINCT source) AS files FROM chunks GROUP BY 1) c USING (project)"""


@query(_with("projects chunks", _LIST))
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.project_list(project_store(spark, sf_dir), chunk_store(spark, sf_dir))


@query(_with("projects chunks", f"SELECT project, concat(project, chr(10), '  Files: ', files, '  Chunks: ', chunks, '  Embed: ', coalesce(embedding, 'unknown'), '  Updated: ', updated) AS report FROM ({_LIST})"))
def list_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.list_report(project_list(spark, sf_dir))


@query(_with("chunks hashes projects", "SELECT project, project IN (SELECT project FROM chunks UNION SELECT project FROM hashes) AS has_data FROM projects"))
def has_indexed_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.indexed(project_store(spark, sf_dir), chunk_store(spark, sf_dir), hash_store(spark, sf_dir))


@query(_with("chunks", "SELECT project, arg_min(provider, id) AS provider, arg_min(model, id) AS model, arg_min(dimensions, id) AS dimensions FROM chunks WHERE provider IS NOT NULL GROUP BY 1"))
def config_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.inferred_config(chunk_store(spark, sf_dir))


@query(
    _with("chunks files", "SELECT project, coalesce(p, 'openai') AS provider, coalesce(m, 'text-embedding-3-small') AS model, coalesce(d, 1536)::INTEGER AS dimensions, CASE WHEN p IS NULL THEN 'default' ELSE 'inferred' END AS origin FROM (SELECT DISTINCT project FROM files UNION SELECT 'pages') LEFT JOIN (SELECT project, arg_min(provider, id) AS p, arg_min(model, id) AS m, arg_min(dimensions, id) AS d FROM chunks WHERE provider IS NOT NULL GROUP BY 1) USING (project)")
)
def config_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No configuration is stored: it is inferred from chunks, or the default."""
    all_projects = project_store(spark, sf_dir)
    return state.resolved_config(all_projects, all_projects.where("false"), chunk_store(spark, sf_dir), FALLBACK)


@query(
    _with(
        "files hashes chunks",
        """+st AS (
  SELECT f.project, f.file_path, CASE WHEN size > 524288 THEN 's' WHEN h.content_hash = sha256(content) THEN 's' ELSE 'w' END AS what
  FROM files f LEFT JOIN hashes h ON h.project = f.project AND h.file_path = f.file_path
), old AS (SELECT project, source AS file_path, count(*) AS n FROM chunks GROUP BY 1, 2),
rows AS (
  SELECT project, what, CASE WHEN what = 'w' THEN coalesce(n, 0) ELSE 0 END AS n FROM st LEFT JOIN old USING (project, file_path)
  UNION ALL SELECT project, 'd', n FROM (SELECT project, file_path FROM hashes EXCEPT SELECT project, file_path FROM files) JOIN old USING (project, file_path)
) SELECT project, count_if(what = 'w' AND n = 0)::BIGINT AS added, count_if(what = 's')::BIGINT AS skipped, count_if(what = 'w' AND n > 0)::BIGINT AS updated, sum(n)::BIGINT AS deleted FROM rows GROUP BY 1""",
    )
)
def index_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, hashes = corpus(spark, sf_dir), hash_store(spark, sf_dir)
    statuses = state.classified(files, hashes)
    return state.counters(statuses, statuses.where("status = 'changed'"), chunk_store(spark, sf_dir), state.deleted(files, hashes))


@query(_with("files hashes", "SELECT * FROM hashes h WHERE (project, file_path) NOT IN (SELECT (project, file_path) FROM files) UNION ALL SELECT project, file_path, sha256(content) FROM files"))
def hash_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = state.hashed(corpus(spark, sf_dir)).select("project", "file_path", "content_hash")
    return state.upserted(hash_store(spark, sf_dir), new, state.KEY)


@query(_with("chunks hashes", "SELECT id, project, source, language, content FROM chunks WHERE (project, source) NOT IN (SELECT (project, file_path) FROM hashes)"))
def chunk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stay when all files with a hash are taken out."""
    return state.without_files(chunk_store(spark, sf_dir), hash_store(spark, sf_dir)).select("id", "project", "source", "language", "content")


@query(_with("chunks hashes", "SELECT project, source AS file_path, count(*) AS removed FROM chunks WHERE (project, source) IN (SELECT (project, file_path) FROM hashes) GROUP BY 1, 2"))
def chunk_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.removed_count(chunk_store(spark, sf_dir), hash_store(spark, sf_dir))


@query(_with("chunks files", "SELECT id, project, source FROM chunks WHERE project <> (SELECT min(project) FROM files)"))
def clear_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = corpus(spark, sf_dir).agg(F.min("project")).first()[0]
    return state.cleared(chunk_store(spark, sf_dir), first).select("id", "project", "source")


# trees


@query(
    _with(
        "files",
        """+d AS (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n FROM files GROUP BY 1),
up AS (SELECT n, dir, unnest(list_transform(range(len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[:i], '/'))) AS folder FROM d),
f AS (SELECT folder, sum(n)::BIGINT AS files FROM up GROUP BY 1),
g AS (SELECT a.folder, count(b.folder) AS dirs FROM f a LEFT JOIN f b ON b.folder <> '' AND b.folder <> a.folder AND (a.folder = '' OR starts_with(b.folder, a.folder || '/')) GROUP BY 1)
SELECT folder, dirs, files, concat('(', CASE WHEN dirs > 0 THEN concat(dirs, 'd ') ELSE '' END, files, 'f)') AS summary FROM f JOIN g USING (folder)""",
    )
)
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.counts(tree.shown(corpus(spark, sf_dir)))


@query(
    _with(
        "files",
        """+s AS (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, doc_id, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.(ts|tsx|js|jsx|mts|mjs|cts|cjs|py|rs|go)$', '') AS name FROM files),
r AS (SELECT folder, name, (row_number() OVER (PARTITION BY folder ORDER BY doc_id) - 1) AS k FROM s)
SELECT folder, (k // 6)::INTEGER AS line_no, string_agg(name, ', ' ORDER BY k) AS line FROM r GROUP BY 1, 2""",
    )
)
def tree_inline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.inline_lines(tree.shown(corpus(spark, sf_dir)))


# structure


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as functions: an order is a file, a line spans as many lines as its quantity."""
    path = F.concat(F.lit("o"), F.pmod("l_orderkey", F.lit(97)).cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit(".ts"))
    line = F.col("l_linenumber").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        path.alias("path"),
        (line * 10_000_000 + F.col("l_partkey")).alias("ordinal"),
        F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"),
        line.alias("line"),
        (line + F.col("l_quantity").cast("int")).alias("line_end"),
    )


_SPANS = """s AS (SELECT concat('o', l_orderkey % 97, '/', l_orderkey, '.ts') AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k,
  concat('f', l_partkey) AS name, l_linenumber AS a, l_linenumber + l_quantity::INTEGER AS b FROM lineitem),
p AS (SELECT c.path, c.k, c.name, d.name AS around, row_number() OVER (PARTITION BY c.path, c.k ORDER BY d.b - d.a, d.k) AS r FROM s c LEFT JOIN s d ON c.path = d.path AND c.k <> d.k AND d.a <= c.a AND d.b >= c.b),
n AS (SELECT path, count(*) AS functions, list_sort(list_distinct(list(CASE WHEN around IS NULL THEN name ELSE around || '.' || name END))) AS names FROM p WHERE r = 1 GROUP BY 1)"""


@query(f"WITH {_SPANS} SELECT path, functions, names FROM n")
def dot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.by_file(spans(spark, sf_dir))


@query(f"WITH {_SPANS} SELECT split_part(path, '/', 1) AS folder, sum(functions)::BIGINT AS functions, list_sort(list_distinct(flatten(list(names)))) AS names FROM n GROUP BY 1")
def files_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.by_folder(nesting.by_file(spans(spark, sf_dir)))


def _scan(spark: SparkSession) -> DataFrame:
    return scan.scanned(scan.selected(snippets.script_files(spark)))


@query(snippets.values("functions", "path, line, col, name, exported, kind"))
def scan_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.compact_functions(_scan(spark))


@query(snippets.values("bindings", "path, line, col, name, kind, refs"))
def scan_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.compact_bindings(_scan(spark))


@query(snippets.values("exports", "path, name, kind_code"))
def scan_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.compact_exports(_scan(spark))


@query("SELECT 4::BIGINT AS files, 4::BIGINT AS parsed, 0::BIGINT AS skipped, 1::BIGINT AS errors")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stats(_scan(spark))


@query(snippets.values("folders", "folder, functions, names"))
def scan_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.folders_view(_scan(spark))

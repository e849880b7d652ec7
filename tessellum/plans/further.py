"""More queries with SQL: filters, scans, chunk rules and whole index runs over the driver's tables.

Where the tables have no such data, it is made of their columns: every document gets a path of
many shapes, every customer a script whose declarations follow from its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.engine import Engine
from tessellum.functions import paths
from tessellum.functions import text as tx
from tessellum.operators import chunking, embedding, search, state, tree
from tessellum.operators.embedding import Config
from tessellum.plans.catalogue import FALLBACK, _LIST, _TOP, _found, _plain_sql, _with, chunk_store, corpus, hash_store, project_store, query, table
from tessellum.sources.store import scratch
from tessellum.structure import scan
from tessellum.structure.extract import KINDS

# paths of many shapes

FOLDERS = ["", "src/", ".hidden/", "node_modules/a/", "lib/.cfg/", "tests/", "a/dist/", "web/gen-1/", "target/x/", "a/b/c/", "__tests__/", "web/gen-2/d/"]
ENDS = [".ts", ".TSX", ".md", "", ".py", ".d.ts", ".Js", ".lock", ".html", ".rs.bak"]
NAMES = ["f", "README", ".env", "Makefile", "LICENSE"]


def _pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


_SHAPED = f"""SELECT doc_id, concat({_pick(FOLDERS, 'doc_id')}, {_pick(NAMES, 'doc_id // 12')}, CASE WHEN doc_id // 12 % 5 IN (0, 2) THEN doc_id % 7 ELSE NULL END, {_pick(ENDS, 'doc_id // 5')}) AS path,
  strlen(text)::BIGINT AS size FROM documents"""


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size) of every document; the paths are of all shapes that filters tell apart."""

    def pick(values: list[str], n: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(f"pmod({n}, {len(values)})") + 1).cast("int"))

    number = F.when(F.expr("pmod(doc_id div 12, 5) in (0, 2)"), F.expr("cast(pmod(doc_id, 7) as string)")).otherwise("")
    path = F.concat(pick(FOLDERS, "doc_id"), pick(NAMES, "doc_id div 12"), number, pick(ENDS, "doc_id div 5"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_ABOVE = "string_split(path, '/')[:-2]"


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def _bad(everything: bool) -> str:
    names = paths.TREE_IGNORED + ([] if everything else paths.TREE_TESTS)
    return f"len(list_filter({_ABOVE}, lambda x: list_contains({_listed(names)}, x) OR starts_with(x, '.'))) > 0"


_SHOWN = f"({_NAME} IN {tuple(paths.TREE_NAMES)} OR regexp_extract({_NAME}, '([^.]*)$', 1) IN {tuple(paths.TREE_EXTS)})"


@query(
    f"""SELECT doc_id, path, regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1) <> '' AND lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1)) IN ('ts', 'tsx', 'js') AS script,
  list_bool_or(list_transform(string_split(path, '/'), lambda x: starts_with(x, '.'))) AS hidden,
  len(list_filter({_ABOVE}, lambda x: list_contains({_listed(paths.SCAN_EXCLUDED)}, x))) > 0 AS excluded, {_SHOWN} AS shown,
  {_bad(False)} AS skipped, {_bad(True)} AS skipped_by_all,
  CASE WHEN starts_with(path, 'a/') THEN path[3:] ELSE '' END AS below_a,
  regexp_replace({_NAME}, '\\.(ts|tsx|js|jsx|mts|mjs|cts|cjs|py|rs|go|java)$', '') AS plain FROM ({_SHAPED})"""
)
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    name = paths.base_name(p)
    return shaped(spark, sf_dir).select(
        "doc_id", "path", paths.has_extension(p, ["ts", "TSX", "js"]).alias("script"), paths.hidden(p).alias("hidden"),
        paths.below_excluded(p, paths.SCAN_EXCLUDED).alias("excluded"), paths.shown_file(name).alias("shown"),
        F.exists(paths.folders(p), lambda x: paths.skipped_folder(x)).alias("skipped"), F.exists(paths.folders(p), lambda x: paths.skipped_folder(x, True)).alias("skipped_by_all"),
        paths.relative("a", p).alias("below_a"), paths.strip_known(name).alias("plain"),
    )


@query(
    f"""SELECT doc_id, path FROM ({_SHAPED}) WHERE lower(regexp_extract({_NAME}, '^.+\\.([^.]*)$', 1)) IN ('ts', 'tsx', 'md') AND size <= 2000
  AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda x: starts_with(x, '.')))
  AND len(list_filter({_ABOVE}, lambda x: list_contains({_listed(paths.SCAN_EXCLUDED)}, x) OR x = 'c' OR starts_with(x, 'gen-'))) = 0"""
)
def scan_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan reads, with extensions, excluded folders and globs, and a size limit."""
    return scan.selected(shaped(spark, sf_dir), ["ts", "tsx", "md"], ["c/", "gen-*"], 2000).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM ({_SHAPED}) WHERE {_SHOWN} AND NOT {_bad(False)}")
def tree_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.shown(shaped(spark, sf_dir), path="path").select("doc_id", "path")


@query(f"SELECT doc_id, path FROM ({_SHAPED}) WHERE {_SHOWN} AND NOT {_bad(True)}")
def tree_shown_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.shown(shaped(spark, sf_dir), True, "path").select("doc_id", "path")


# texts

_BLANKS = "^[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*$"


def _cut_sql(text: str, most: int) -> str:
    """The longest prefix of whole characters within so many bytes: most // 4 characters fit at any rate."""
    return f"left({text}, list_max(list_filter(range({most // 4}, {most + 1}), lambda i: strlen(left({text}, i)) <= {most})))"


@query(f"SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE {_cut_sql('text', 200)} END AS cut, CASE WHEN strlen(text) > 200 THEN {_cut_sql('text', 200)} || chr(10) || '...' ELSE text END AS snippet FROM documents")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at a character border within 200 bytes, as they are for vectors and for snippets."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.cut_bytes(F.col("text"), 200).alias("cut"), tx.snippet(F.col("text"), 200).alias("snippet"))


@query(
    f"""SELECT doc_id, k AS line_no, line, regexp_matches(line, '{_BLANKS}') AS blank FROM (
  SELECT doc_id, unnest(parts) AS line, (generate_subscripts(parts, 1) - 1)::INTEGER AS k FROM (
    SELECT doc_id, CASE WHEN t = '' OR t[-1] = chr(10) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS parts FROM (
      SELECT doc_id, regexp_replace(text, '\\r\\n', chr(10), 'g') AS t FROM documents)))"""
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "line"))
    return lines.withColumn("blank", tx.is_blank(F.col("line")))


def _measured():  # noqa: ANN202
    """Stands for a service: what it is sent of each text, in bytes and characters."""

    def call(texts):  # noqa: ANN001, ANN202
        sent = [embedding.cut(t, 300) for t in texts]
        return [[float(len(s.encode())), float(len(s)), float(len(texts) <= embedding.BATCH)] for s in sent]

    return call


@query(f"SELECT doc_id, [strlen(c), length(c), 1]::FLOAT[] AS embedding FROM (SELECT doc_id, CASE WHEN strlen(text) <= 300 THEN text ELSE {_cut_sql('text', 300)} END AS c FROM documents)")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text gets the vector that the provider made of it, in batches and cut to the bytes that may be sent."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk"))
    return embedding.embedded(rows, lambda: _measured()).select("doc_id", "embedding")


@query(
    _with("chunks", f"SELECT id, concat_ws(chr(10), concat(chr(10), '### ', source, '  (', format('{{:.1f}}%', score * 100), ')'), concat('```', language), CASE WHEN strlen(content) > 1200 THEN concat({_cut_sql('content', 1200)}, chr(10), '...') ELSE content END, '```') AS snippet FROM (" + _TOP.format(where="", limit=40) + ") WHERE NOT score < 0")
)
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.snippets(_found(spark, sf_dir, limit=40))


# orders


@query(_with("projects chunks", f"SELECT project, (row_number() OVER (ORDER BY updated DESC, project) - 1)::BIGINT AS pos FROM ({_LIST})"))
def project_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects in the order of the list: the last updated first."""
    return state.project_list(project_store(spark, sf_dir), chunk_store(spark, sf_dir)).coalesce(1).select("project", F.monotonically_increasing_id().alias("pos"))


@query(_with("chunks", "SELECT source, (row_number() OVER (ORDER BY best DESC, source) - 1)::BIGINT AS pos FROM (SELECT source, greatest(max(score), 0) AS best FROM (" + _TOP.format(where="", limit=400) + ") WHERE NOT score < -1 GROUP BY 1)"))
def files_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a search in order of their best scores."""
    return search.best_of_files(_found(spark, sf_dir, limit=400, threshold=-1.0)).coalesce(1).select("source", F.monotonically_increasing_id().alias("pos"))


# the state of an index


@query(_with("files hashes", "SELECT project, file_path, CASE WHEN size > 1500 THEN 'oversized' WHEN h.content_hash = sha256(content) THEN 'unchanged' ELSE 'changed' END AS status FROM files f LEFT JOIN hashes h USING (project, file_path)"))
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run with a limit of 1,500 bytes makes of each file."""
    return state.classified(corpus(spark, sf_dir), hash_store(spark, sf_dir), max_bytes=1500).select("project", "file_path", "status")


@query(
    _with("chunks projects", """SELECT project, CASE WHEN stored THEN 'openai' ELSE coalesce(p, 'openai') END AS provider, CASE WHEN stored OR p IS NOT NULL THEN 'text-embedding-3-large' ELSE 'text-embedding-3-small' END AS model,
  CASE WHEN stored OR p IS NOT NULL THEN 2000 ELSE 1536 END AS dimensions, CASE WHEN stored THEN 'stored' WHEN p IS NOT NULL THEN 'inferred' ELSE 'default' END AS origin
  FROM (SELECT project, provider IS NOT NULL AND project < 'src3' AS stored FROM projects) LEFT JOIN (SELECT project, min(provider) AS p FROM chunks WHERE provider IS NOT NULL GROUP BY 1) USING (project)""")
)
def config_resolve_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some projects have a stored configuration, the others that of their chunks, or the default."""
    every = project_store(spark, sf_dir)
    return state.resolved_config(every, every.where("project < 'src3' and provider is not null"), chunk_store(spark, sf_dir), FALLBACK)


@query(
    _with("projects", f"""SELECT project, CASE WHEN project < 'src3' THEN 'hashed' ELSE provider END AS provider, CASE WHEN project < 'src3' THEN 'words-256' ELSE model END AS model,
  CASE WHEN project < 'src3' THEN 256 ELSE dimensions END AS dimensions, created_at FROM projects UNION ALL SELECT 'new', 'hashed', 'words-256', 256, make_timestamp(0)""")
)
def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored configurations after some are replaced, which keeps when they were made, and one is added."""
    old = project_store(spark, sf_dir)
    names = old.where("project < 'src3'").select("project").unionByName(spark.createDataFrame([("new",)], "project string"))
    then = F.timestamp_seconds(F.lit(0))
    new = names.select("project", F.lit("hashed").alias("provider"), F.lit("words-256").alias("model"), F.lit(256).alias("dimensions"), F.lit(1).alias("config_version"), then.alias("created_at"), then.alias("updated_at"))
    return state.upserted(old, new, ["project"], keep=["created_at", "config_version"]).select("project", "provider", "model", "dimensions", "created_at")


# chunks by rule

PROSE = ["md", "json", "mdx", "yaml", "toml", "yml"]
_PROSE = f"SELECT doc_id, concat('docs/', doc_id, '.', {_pick(PROSE, 'doc_id')}) AS file_path, text FROM documents"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_path, content): every document as a file that is split by headings or by lines."""
    ext = F.element_at(F.array(*[F.lit(e) for e in PROSE]), (F.pmod("doc_id", F.lit(len(PROSE))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"), F.col("text").alias("content"))


def _white(x: str) -> str:
    marks = _BLANKS[1:-2]
    return f"regexp_replace(regexp_replace({x}, '^{marks}+', ''), '{marks}+$', '')"


def _markdown_sql(size: int = 1000, overlap: int = 100) -> str:
    """Line after line; the tail that is kept is the longest of whole characters within `overlap` bytes."""
    tail = f"right(h, list_max(list_filter(range(0, {overlap + 1}), lambda i: strlen(right(h, i)) <= {overlap})))"
    none = "[]::VARCHAR[]"
    return f"""WITH RECURSIVE parts AS (
  SELECT doc_id, CASE WHEN t = '' OR t[-1] = chr(10) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS rows
  FROM (SELECT doc_id, regexp_replace(text, '\\r\\n', chr(10), 'g') AS t FROM documents)
), step(doc_id, k, held, chunks) AS (
  SELECT doc_id, 0, '', NULL::VARCHAR[] FROM parts
  UNION ALL
  SELECT doc_id, k + 1,
    CASE WHEN k >= n THEN '' WHEN strlen(h) >= {size} AND NOT heading THEN {tail} ELSE h END,
    CASE WHEN k >= n THEN CASE WHEN {_white('held')} <> '' THEN [{_white('held')}] END
      ELSE list_concat(CASE WHEN heading AND {_white('held')} <> '' THEN [{_white('held')}] ELSE {none} END, CASE WHEN strlen(h) >= {size} AND NOT heading THEN [{_white('h')}] ELSE {none} END) END
  FROM (
    SELECT s.doc_id, k, held, len(rows) AS n, starts_with(rows[k + 1], '#') AS heading,
      CASE WHEN starts_with(rows[k + 1], '#') AND {_white('held')} <> '' THEN '' ELSE held END || rows[k + 1] || chr(10) AS h
    FROM step s JOIN parts p USING (doc_id) WHERE k <= len(rows)
  )
)"""


_MARKDOWN = _markdown_sql()
_NUMBERED = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INTEGER AS chunk_no, chunk FROM (SELECT doc_id, k, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS j FROM step WHERE len(chunks) > 0)"


@query(f"{_MARKDOWN} {_NUMBERED}")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.exploded(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), chunking.markdown_chunks(F.col("content"))).select("doc_id", "chunk_no", "chunk")


def _dispatched(texts: str = "documents") -> str:
    """(file_path, chunk_no, chunk) by the rule of each file's extension."""
    md = _MARKDOWN.replace("FROM documents", f"FROM {texts} WHERE doc_id % {len(PROSE)} IN (0, 2)")
    plain = _plain_sql(1000, 100).replace("FROM documents", f"FROM {texts} WHERE doc_id % {len(PROSE)} NOT IN (0, 2)")
    return f"SELECT concat('docs/', doc_id, '.', {_pick(PROSE, 'doc_id')}) AS file_path, chunk_no, chunk FROM (SELECT * FROM ({md} {_NUMBERED}) UNION ALL SELECT * FROM ({plain}))"


@query(_dispatched())
def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the rule of their extension: Markdown by headings, other prose by lines."""
    return chunking.chunked(prose(spark, sf_dir)).select("file_path", "chunk_no", "chunk")


# whole runs of an index


def _indexed_twice(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[dict[str, int]]]:
    """An index of all documents, then of all as they are after the toxic ones were edited and those of quality 0 deleted."""
    engine = Engine(spark, scratch(spark, "index"), default=Config("hashed", "words-256", 256))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    files = prose(spark, sf_dir).withColumn("project", F.lit("p")).withColumn("size", F.octet_length("content").cast("long"))
    first = engine.index_table(files.drop("doc_id"), "p")
    later = files.join(marks, "doc_id", "left").where("quality is null or quality = 1").withColumn("content", F.when(F.col("toxic") == 1, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")))
    later = later.withColumn("size", F.octet_length("content").cast("long")).drop("doc_id", "toxic", "quality")
    return engine, [first, engine.index_table(later, "p")]


_LATER = "(SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN text || chr(10) || 'edited' ELSE text END AS text FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"
_LANGS = "CASE WHEN regexp_extract(file_path, '([^.]*)$', 1) IN ('md', 'mdx') THEN 'markdown' WHEN regexp_extract(file_path, '([^.]*)$', 1) IN ('yaml', 'yml') THEN 'yaml' ELSE regexp_extract(file_path, '([^.]*)$', 1) END"


@query(f"SELECT concat('p/', file_path, '#', lpad(chunk_no::VARCHAR, 9, '0')) AS id, chunk AS content, 'p' AS project, file_path AS source, {_LANGS} AS language, 'hashed' AS provider, 'words-256' AS model, 256 AS dimensions, 256 AS width FROM ({_dispatched(_LATER)})")
def index_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after two runs: edited files have new chunks, deleted ones keep theirs until a forced run."""
    engine, _ = _indexed_twice(spark, sf_dir)
    return engine.store.read("chunks").select("id", "content", "project", "source", "language", "provider", "model", "dimensions", F.size("embedding").alias("width"))


@query(
    f"""WITH a AS (SELECT count(DISTINCT file_path) AS n FROM ({_dispatched()})),
m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1),
c AS (SELECT file_path, count(*) AS n FROM ({_dispatched()}) GROUP BY 1),
f AS (SELECT d.doc_id, concat('docs/', d.doc_id, '.', {_pick(PROSE, 'd.doc_id')}) AS file_path, toxic, coalesce(quality, 1) AS quality FROM documents d LEFT JOIN m USING (doc_id))
SELECT 1 AS run, n AS added, 0::BIGINT AS skipped, 0::BIGINT AS updated, 0::BIGINT AS deleted FROM a
UNION ALL SELECT 2, count_if(edited AND c.n IS NULL), count_if(NOT edited AND c.n IS NOT NULL), count_if(edited AND c.n IS NOT NULL), coalesce(sum(c.n) FILTER (WHERE edited), 0)::BIGINT
FROM (SELECT *, coalesce(toxic, 0) = 1 AS edited FROM f WHERE quality = 1) LEFT JOIN c USING (file_path)"""
)
def index_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both runs report; files without a chunk are never hashed, so they are neither added nor skipped."""
    _, runs = _indexed_twice(spark, sf_dir)
    return spark.createDataFrame([(i + 1, r["added"], r["skipped"], r["updated"], r["deleted"]) for i, r in enumerate(runs)], "run int, added long, skipped long, updated long, deleted long")


# scripts made of rows

_SCRIPT = [
    "import dep{n} from './m{n}';",
    "export async function load{k}(id, opts) {{ return dep{n}(id); }}",
    "const make{k} = () => 1;",
    "class Box{k} {{ constructor() {{}} size() {{ return make{k}(); }} get wide() {{ return 2; }} set wide(v) {{}} }}",
    "const bag{k} = {{ take() {{ return 3; }} }};",
]


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, size): a script for each customer."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    lines = [F.replace(F.replace(F.lit(line.replace("{{", "{").replace("}}", "}")), F.lit("{k}"), k), F.lit("{n}"), n) for line in _SCRIPT]
    last = F.when(F.expr("pmod(c_custkey, 2) = 0"), F.concat(F.lit("export { Box"), k, F.lit(" };"))).otherwise(F.concat(F.lit("export default Box"), k, F.lit(";")))
    path = F.concat(F.lit("n"), n, F.lit("/c"), k, F.lit(".ts"))
    rows = table(spark, sf_dir, "customer").select(path.alias("path"), F.concat_ws("\n", *lines, last).alias("content"))
    return rows.withColumn("size", F.octet_length("content").cast("long"))


_C = "c AS (SELECT c_custkey AS k, length(c_custkey::VARCHAR) AS w, c_nationkey AS n, length(c_nationkey::VARCHAR) AS u, concat('n', c_nationkey, '/c', c_custkey, '.ts') AS path FROM customer)"
_FUNCTIONS = """SELECT path, 2 AS line, 8 AS col, concat('load', k) AS name, 1 AS exported, 'fn' AS kind FROM c
UNION ALL SELECT path, 3, (14 + w)::INTEGER, concat('make', k), 0, 'arr' FROM c
UNION ALL SELECT path, 4, (13 + w)::INTEGER, 'constructor', 0, 'ctor' FROM c
UNION ALL SELECT path, 4, (30 + w)::INTEGER, 'size', 0, 'cls' FROM c
UNION ALL SELECT path, 4, (56 + 2 * w)::INTEGER, 'wide', 0, 'get' FROM c
UNION ALL SELECT path, 4, (81 + 2 * w)::INTEGER, 'wide', 0, 'set' FROM c
UNION ALL SELECT path, 5, (15 + w)::INTEGER, 'take', 0, 'obj' FROM c"""


def _kinds_sql() -> str:
    lists = {name: tuple(sorted(kinds)) if len(kinds) > 1 else f"('{next(iter(kinds))}')" for name, kinds in KINDS.items()}
    return " UNION ALL ".join(f"SELECT '{name}' AS kinds, * FROM f WHERE kind IN {kinds}" for name, kinds in lists.items())


@query(f"WITH {_C}, f AS ({_FUNCTIONS}) {_kinds_sql()}")
def script_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of all scripts under each filter of kinds."""
    return scan.kinds_view(scan.scanned(scan.selected(scripts(spark, sf_dir))), list(KINDS))


@query(
    f"""WITH {_C} SELECT path, 1 AS line, (8)::INTEGER AS col, concat('dep', n) AS name, 'import' AS kind, 1 AS refs, false AS exported FROM c
UNION ALL SELECT path, 2, 23, concat('load', k), 'fn', 0, true FROM c
UNION ALL SELECT path, 2, (28 + w)::INTEGER, 'id', 'var', 1, false FROM c
UNION ALL SELECT path, 2, (32 + w)::INTEGER, 'opts', 'var', 0, false FROM c
UNION ALL SELECT path, 3, 7, concat('make', k), 'const', 1, false FROM c
UNION ALL SELECT path, 4, 7, concat('Box', k), 'class', 1, k % 2 = 0 FROM c
UNION ALL SELECT path, 4, (90 + 2 * w)::INTEGER, 'v', 'var', 0, false FROM c
UNION ALL SELECT path, 5, 7, concat('bag', k), 'const', 0, false FROM c"""
)
def script_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of all scripts; exported ones are those that an export names."""
    return scan.bindings(scan.scanned(scripts(spark, sf_dir))).select("path", "line", "col", "name", "kind", "refs", "exported")


@query(f"WITH {_C} SELECT path, concat('load', k) AS name, 1 AS kind_code FROM c UNION ALL SELECT path, CASE WHEN k % 2 = 0 THEN concat('Box', k) ELSE 'default' END, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END FROM c")
def script_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.compact_exports(scan.scanned(scripts(spark, sf_dir)))


@query("SELECT count(*) AS files, count(*) AS parsed, 0::BIGINT AS skipped, 0::BIGINT AS errors FROM customer")
def script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stats(scan.scanned(scripts(spark, sf_dir)))


@query(f"WITH {_C} SELECT concat('n', n) AS folder, 7 * count(*) AS functions FROM c GROUP BY n")
def script_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.folders_view(scan.scanned(scripts(spark, sf_dir))).select("folder", "functions")


@query(f"WITH {_C} SELECT path, 0::BIGINT AS functions, []::VARCHAR[] AS names FROM c")
def script_files_without_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which a scan finds no function have an empty list of names."""
    return scan.files_view(scan.scanned(scripts(spark, sf_dir).withColumn("content", F.lit("let x = 1;"))))


# outlines

OUTLINE = ["README.md", "src/a.ts", "src/b2.ts", "src/b10.ts", "src/deep/only/x.py", "docs/1.md", "docs/2.md", "docs/3.md", "docs/4.md", "docs/5.md", "docs/6.md", "docs/7.md", "src/tests/t.ts", ".git/config.json", "lone/f.rs"]
OUTLINED = ["docs/", "  1.md, 2.md, 3.md, 4.md, 5.md, 6.md", "  7.md", "lone/  f", "src/", "  deep/only/  x", "  a, b2, b10", "README.md"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{line}')" for i, line in enumerate(OUTLINED)) + ") t(line_no, line)")
def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed outline of a handful of paths, line by line, without its frame; expected lines are worked out by hand."""
    text = tree.outline(spark.createDataFrame([(p,) for p in OUTLINE], "file_path string"))
    body = [x for x in text.split("\n\n", 1)[1].split("\n\n")[0].split("\n") if x]
    return spark.createDataFrame(list(enumerate(body)), "line_no long, line string")

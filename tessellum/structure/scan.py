"""Scanning a table of sources: one struct of functions, bindings and exports for each file.

The parser runs in Arrow batches, a file at a time; everything behind it is relational.
"""

from __future__ import annotations

import fnmatch
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tessellum.functions import batches, paths
from tessellum.structure import nesting
from tessellum.structure.extract import KINDS, LABELS, extracted
from tessellum.structure.syntax import EXTENSIONS

MAX_BYTES = 1_048_576
INDEX = (
    "struct<functions:array<struct<name:string,kind:string,exported:boolean,is_async:boolean,is_generator:boolean,line:int,col:int,line_end:int>>,"
    "bindings:array<struct<name:string,kind:string,exported:boolean,refs:int,line:int,col:int>>,"
    "exports:array<struct<name:string,kind_code:int>>,parse_errors:int,error:string>"
)


def selected(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of files(path, content, size) that a scan reads; null sizes pass, exclude names folders or has globs of their names."""
    p, own = F.col("path"), [x.strip("/") for x in exclude or []]
    globs = [fnmatch.translate(x) for x in own if set(x) & set("*?[")]
    ok = paths.has_extension(p, include or paths.SCANNED) & ~paths.hidden(p) & ~paths.below_excluded(p, paths.SCAN_EXCLUDED + own)
    if globs:
        ok &= ~F.exists(paths.folders(p), lambda name: F.rlike(name, F.lit("|".join(globs).replace("\\Z", "\\z"))))
    return files.where(ok & F.coalesce(F.col("size") <= max_bytes, F.lit(True)))


def scanned(files: DataFrame, kinds: str = "all") -> DataFrame:
    """files(path, content) with index; a null content or an unknown extension gives its error.

    Parsing takes so much longer than moving a text that the files are spread over all cores first.
    """
    if kinds not in KINDS:
        raise ValueError(f"kinds is one of {', '.join(KINDS)}")
    kind = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(INDEX).fields])
    empty = {"functions": [], "bindings": [], "exports": [], "parse_errors": 0}

    def one(path: str | None, text: str | None) -> dict:
        ext = (path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower()
        if text is None:
            return {**empty, "error": f"failed to read {path}"}
        if ext not in EXTENSIONS:
            return {**empty, "error": f"unsupported file type: {path}"}
        return {**extracted(text, ext, kinds), "error": None}

    def some(path: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([one(p, t) for p, t in zip(path.to_pylist(), content.to_pylist(), strict=True)], kind)

    @F.arrow_udf(INDEX)
    def index(path: pa.Array, content: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(path[i:j], content[i:j]) for i, j in batches.parts(content)] or [some(path, content)])

    # a filter on the index would else be pushed below it, and every file parsed once more
    return batches.bounded(batches.spread(files, "path", "content")).withColumn("index", index.asNondeterministic()("path", "content")).drop("content")


def functions(scan: DataFrame) -> DataFrame:
    return scan.select("path", F.posexplode("index.functions").alias("ordinal", "f")).select("path", "ordinal", "f.*")


def bindings(scan: DataFrame) -> DataFrame:
    return scan.select("path", F.posexplode("index.bindings").alias("ordinal", "b")).select("path", "ordinal", "b.*")


def exports(scan: DataFrame) -> DataFrame:
    return scan.select("path", F.posexplode("index.exports").alias("ordinal", "x")).select("path", "ordinal", "x.*")


def stats(scan: DataFrame) -> DataFrame:
    """One row: files, parsed, skipped, errors."""
    failed = F.col("index.error").isNotNull()
    return scan.agg(
        F.count("*").alias("files"),
        F.count_if(~failed).alias("parsed"),
        F.count_if(failed).alias("skipped"),
        F.count_if(failed | (F.col("index.parse_errors") > 0)).alias("errors"),
    )


def compact_functions(scan: DataFrame) -> DataFrame:
    return functions(scan).select("path", "line", "col", F.coalesce("name", F.lit("")).alias("name"), F.col("exported").cast("int").alias("exported"), "kind")


def kinds_view(scan: DataFrame, kinds: list[str]) -> DataFrame:
    """compact_functions() under each of the filters, with its name in front; scan has all kinds, and is parsed once for all filters."""
    names = F.array_compact(F.array(*[F.when(F.col("kind").isin(sorted(KINDS[k])), F.lit(k)) for k in kinds]))
    return compact_functions(scan).select(F.explode(names).alias("kinds"), "*")


def compact_bindings(scan: DataFrame) -> DataFrame:
    return bindings(scan).select("path", "line", "col", "name", "kind", "refs")


def compact_exports(scan: DataFrame) -> DataFrame:
    return exports(scan).select("path", "name", "kind_code")


def files_view(scan: DataFrame) -> DataFrame:
    """(path, functions, names) of every file that could be read."""
    own = scan.where("index.error is null")
    return own.select("path", F.size("index.functions").cast("long").alias("functions"), nesting.dotted_names(F.col("index.functions")).alias("names"))


def folders_view(scan: DataFrame) -> DataFrame:
    return nesting.by_folder(files_view(scan))


def rendered(scan: DataFrame, mode: str = "compact", root: str = "") -> str:
    """The scan of one project as JSON text; it is for a terminal, so the rows come to the driver."""
    head = {"ver": 1}
    counts = stats(scan).first().asDict()
    if mode in ("files", "folders"):
        view = files_view(scan) if mode == "files" else folders_view(scan)
        key = "path" if mode == "files" else "folder"
        rows = sorted(view.collect(), key=lambda r: r[key].encode())
        body = {r[key]: r["names"] if mode == "files" else {"functions": r["functions"], "names": r["names"]} for r in rows}
        return json.dumps({**head, "stats": counts, mode: body}, ensure_ascii=False, indent=2)
    if mode not in ("compact", "verbose"):
        raise ValueError("mode is compact, verbose, files or folders")
    rows = sorted(scan.select("path", "index").collect(), key=lambda r: r["path"].encode())
    good = [(r["path"], r["index"]) for r in rows if r["index"]["error"] is None]
    errors = [r["index"]["error"] for r in rows if r["index"]["error"] is not None]
    if mode == "compact":
        out = {
            **head,
            "stats": counts,
            "f": [[p, f["line"], f["col"], f["name"] or "", int(f["exported"]), f["kind"]] for p, i in good for f in i["functions"]],
            "b": [[p, b["line"], b["col"], b["name"], b["kind"], b["refs"]] for p, i in good for b in i["bindings"]],
            "x": [[p, x["name"], x["kind_code"]] for p, i in good for x in i["exports"]],
        }
        return json.dumps(out | ({"err": errors} if errors else {}), ensure_ascii=False, separators=(",", ":"))
    spot = lambda line, col: {"line": line, "col": col}
    out = {
        **head,
        "root": root,
        "stats": counts,
        "functions": [
            {"file": p, "name": f["name"], "kind": LABELS[f["kind"]], "exported": f["exported"], "isAsync": f["is_async"], "isGenerator": f["is_generator"], "span": {"start": spot(f["line"], f["col"]), "end": spot(f["line_end"], 0)}}
            for p, i in good
            for f in i["functions"]
        ],
        "bindings": [{"file": p, "name": b["name"], "kind": b["kind"], "exported": b["exported"], "refs": b["refs"], "decl": spot(b["line"], b["col"])} for p, i in good for b in i["bindings"]],
        "exports": [{"file": p, "name": x["name"], "kindCode": x["kind_code"]} for p, i in good for x in i["exports"]],
    }
    return json.dumps(out | ({"errors": errors} if errors else {}), ensure_ascii=False, indent=2)

"""Files as tables: discovery by git or by walking, and contents through binaryFile.

Lists of paths are made where the files are known, on the driver; contents are read by
tasks.  The size filter goes down to the scan, so that large files are never opened.
"""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import paths

INDEX_BYTES, SCAN_BYTES = 524_288, 1_048_576


def project_id(root: str) -> str:
    """The folder that holds the repository, one for all its work trees; root itself outside of git."""
    top = Path(root).resolve(strict=True)
    run = subprocess.run("git rev-parse --git-common-dir".split(), cwd=top, capture_output=True, text=True, check=False)
    if run.returncode == 0:
        place = (top / run.stdout.strip()).resolve()
        if place.exists():
            return str(place.parent)
    return str(top)


def relative_file(root: str, file: str) -> str:
    """file below root; as it was given if it lies elsewhere."""
    whole = Path(file) if os.path.isabs(file) else Path(root) / file
    try:
        return str(whole.relative_to(root))
    except ValueError:
        return file


def git_files(root: str, ignore_file: str | None = None) -> list[str]:
    """Tracked and unignored paths below root that can be indexed, as git gives them."""
    extra = ["-c", f"core.excludesFile={ignore_file}"] if ignore_file else []
    command = ["git", *extra, *"ls-files -z --exclude-standard --others --cached".split()]
    run = subprocess.run(command, cwd=root, capture_output=True, check=False)
    if run.returncode != 0:
        raise ValueError(f"{root} is not in a git repository")
    names = run.stdout.decode(errors="replace").split("\0")
    return [n for n in names if n and n.rsplit(".", 1)[-1] in paths.LANGUAGES]


def _pattern(glob: str) -> re.Pattern[str]:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return re.compile(out + r"\Z", re.S)


class Ignored:
    """The rules of one ignore file, for paths below its folder."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern[str], bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only_folders, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            self.rules.append((_pattern(line.lstrip("/") if anchored else "**/" + line), keep, only_folders))

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored; False: kept in spite of other rules; None: nothing said."""
        said = None
        for pattern, keep, only_folders in self.rules:
            if (folder or not only_folders) and pattern.match(path):
                said = not keep
        return said


def walked(root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = SCAN_BYTES) -> list[str]:
    """Paths that a scan reads: no hidden, ignored, excluded or oversized ones; sorted by parts."""
    exts = {e.lower() for e in include or paths.SCANNED}
    bad = [_pattern(x.strip("/")) for x in [*paths.SCAN_EXCLUDED, *(exclude or [])]]
    in_git = (Path(root) / ".git").exists() or _inside_git(root)
    found: list[str] = []

    def visit(rel: str, rules: list[tuple[str, Ignored]]) -> None:
        here = os.path.join(root, rel)
        if in_git and os.path.isfile(own := os.path.join(here, ".gitignore")):
            with open(own, errors="replace") as f:
                rules = [*rules, (rel, Ignored(f.read()))]
        for e in os.scandir(here):
            path = f"{rel}/{e.name}" if rel else e.name
            folder = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or _said(rules, path, folder):
                continue
            if folder:
                if not any(p.match(e.name) or p.match(path) for p in bad):
                    visit(path, rules)
            elif e.is_file(follow_symlinks=False):
                stem, _, ext = e.name.rpartition(".")
                if stem and ext.lower() in exts and e.stat().st_size <= max_bytes:
                    found.append(path)

    visit("", [])
    return sorted(found, key=lambda p: [x.encode() for x in p.split("/")])


def _inside_git(root: str) -> bool:
    run = subprocess.run("git rev-parse".split(), cwd=root, capture_output=True, check=False)
    return run.returncode == 0


def _said(rules: list[tuple[str, Ignored]], path: str, folder: bool) -> bool:
    for base, rule in reversed(rules):  # the nearest file that says something decides
        said = rule.verdict(path[len(base) :].lstrip("/"), folder)
        if said is not None:
            return said
    return False


def tree_entries(root: str, subpath: str = "", everything: bool = False) -> tuple[list[str], list[str]]:
    """(folders, files) that a tree shows, relative to root. Links are neither; no ignore file counts."""
    top = Path(root).resolve(strict=True)
    start = (top / subpath.strip("/")).resolve(strict=True)
    if start != top and top not in start.parents:
        raise ValueError("the path must lie inside the project")
    folders, files, tests = [], [], set() if everything else set(paths.TREE_TESTS)

    def visit(here: Path) -> None:
        for e in os.scandir(here):
            rel = os.path.relpath(e.path, top)
            if e.is_dir(follow_symlinks=False):
                if not (e.name in paths.TREE_IGNORED or e.name.startswith(".") or e.name in tests):
                    folders.append(rel)
                    visit(Path(e.path))
            elif e.is_file(follow_symlinks=False) and (e.name in paths.TREE_NAMES or e.name.rsplit(".", 1)[-1] in paths.TREE_EXTS):
                files.append(rel)

    visit(start)
    return folders, files


def contents(spark: SparkSession, root: str, names: list[str], project: str, max_bytes: int | None = None) -> DataFrame:
    """(project, file_path, content, size) of the named files below root.

    Content is null where a file is not UTF-8 or, with max_bytes, too large to be read.
    """
    schema = "project string, file_path string, content string, size long"
    base = Path(root).resolve()
    there = [n for n in names if (base / n).is_file()]
    # the scan leaves out files without a byte
    empty = spark.createDataFrame([(project, n, "", 0) for n in there if (base / n).stat().st_size == 0], schema)
    found = [n for n in there if (base / n).stat().st_size > 0]
    if not found:
        return empty
    scan = spark.read.format("binaryFile").load(["file://" + re.sub(r"([\[\]{}*?\\])", r"\\\1", str(base / n)) for n in found])
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    small = scan if max_bytes is None else scan.where(F.col("length") <= max_bytes)
    rows = small.select("path", text.alias("content"), F.col("length").alias("size"))
    if max_bytes is not None:
        rows = rows.unionByName(scan.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("content"), F.col("length").alias("size")))
    # the scan names files by URI; a small table leads back to the names as they were given
    plain = spark.createDataFrame([(str(base / n), n) for n in found], "whole string, file_path string")
    whole = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    rows = rows.withColumn("whole", whole).join(plain, "whole").select(F.lit(project).alias("project"), "file_path", "content", "size")
    return rows.unionByName(empty)


def folder(spark: SparkSession, place: str, project: str, max_bytes: int = INDEX_BYTES) -> DataFrame:
    """The same for a whole folder of any file system, listed and read by tasks; oversized files have no content."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place)
    root = place.rstrip("/")
    rel = F.regexp_replace(F.substring_index(F.col("path"), re.sub("^[a-z0-9]+:/*", "", root), -1), "^/+", "")
    small = scan.where(F.col("length") <= max_bytes).select(rel.alias("file_path"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("content"), F.col("length").alias("size"))
    large = scan.where(F.col("length") > max_bytes).select(rel.alias("file_path"), F.lit(None).cast("string").alias("content"), F.col("length").alias("size"))
    return small.unionByName(large).where(paths.is_indexable(F.col("file_path"))).select(F.lit(project).alias("project"), "file_path", "content", "size")

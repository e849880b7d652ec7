"""Trees of folders: counts of what is below, and the compact printed outline.

Paths become edges; every folder's counts come from exploding the folders above each file
and one aggregation.  Only the outline itself is drawn on the driver, from aggregated rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import paths

DEPTH, INLINE = 6, 6


def shown(files: DataFrame, everything: bool = False, path: str = "file_path") -> DataFrame:
    """The files that a tree shows: known names or extensions, below no folder that is left out."""
    p = F.col(path)
    bad = F.exists(paths.folders(p), lambda name: paths.skipped_folder(name, everything))
    return files.where(paths.shown_file(paths.base_name(p)) & ~bad)


def _above(path: Column) -> Column:
    """All folders above a path, '' for the top."""
    parts = paths.folders(path)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _count(n: Column, what: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))


def summary(dirs: Column, files: Column) -> Column:
    """(2d 5f), without the part that is zero."""
    return F.concat(F.lit("("), F.concat_ws(" ", _count(dirs, "d"), _count(files, "f")), F.lit(")"))


def counts(files: DataFrame, path: str = "file_path", by: list[str] | None = None) -> DataFrame:
    """(folder, dirs, files, summary) of every folder: all that is below it.

    by names columns, such as project, that hold trees apart.
    """
    by = by or []
    own = files.select(*by, paths.parent_dir(F.col(path)).alias("dir")).groupBy(*by, "dir").agg(F.count("*").alias("n"))
    # from here on there is a row for each folder, not for each file
    at = F.when(F.col("dir") == ".", F.lit("x")).otherwise(F.concat("dir", F.lit("/x")))
    up = own.select(*by, "n", "dir", F.explode(_above(at)).alias("folder"))
    n_files = up.groupBy(*by, "folder").agg(F.sum("n").alias("files"))
    below = n_files.where("folder <> ''").select(*by, F.explode(_above(F.col("folder"))).alias("folder"))
    n_dirs = below.groupBy(*by, "folder").agg(F.count("*").alias("dirs"))
    rows = n_files.join(n_dirs, [*by, "folder"], "left").withColumn("dirs", F.coalesce("dirs", F.lit(0)))
    return rows.select(*by, "folder", "dirs", "files", summary(F.col("dirs"), F.col("files")).alias("summary"))


def inline_lines(files: DataFrame, inline: int = INLINE, path: str = "file_path", by: list[str] | None = None) -> DataFrame:
    """(folder, line_no, line): the files right in a folder in natural order, so many to a line."""
    by, p = by or [], F.col(path)
    name = paths.base_name(p)
    per = max(1, inline)
    own = files.select(*by, paths.parent_dir(p).alias("folder"), paths.natural_key(name).alias("key"))
    names = own.groupBy(*by, "folder").agg(F.transform(F.sort_array(F.collect_list("key")), lambda k: paths.strip_known(k["name"])).alias("names"))
    lines = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("names") - 1) / per).cast("int")), lambda i: F.array_join(F.slice(F.col("names"), i * per + 1, per), ", ")
    )
    return names.select(*by, "folder", F.posexplode(lines).alias("line_no", "line"))


@dataclass
class Node:
    name: str = ""
    path: str = ""
    dirs: dict[str, Node] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)

    def count(self) -> tuple[int, int]:
        below = [d.count() for d in self.dirs.values()]
        return len(self.dirs) + sum(d for d, _ in below), len(self.files) + sum(f for _, f in below)

    def summary(self) -> str:
        return "(" + " ".join(f"{n}{c}" for n, c in zip(self.count(), "df", strict=True) if n) + ")"


def built(rows: list[tuple[str, list[str]]], top: str = "") -> Node:
    """The nodes of (folder, displayed files in order), as far as they lie below top."""
    root = Node(top.rsplit("/", 1)[-1], top)
    for folder, names in sorted((("" if f == "." else f), n) for f, n in rows):
        if top and folder != top and not folder.startswith(top + "/"):
            continue
        node = root
        for part in filter(None, folder[len(top) :].split("/")):
            node = node.dirs.setdefault(part, Node(part, f"{node.path}/{part}".lstrip("/")))
        node.files.extend(names)
    return root


def drawn(root: Node, depth: int = DEPTH, inline: int = INLINE) -> list[str]:
    """The outline's lines: chains of single folders on one line, few files behind their folder."""
    depth, inline, out = max(1, depth), max(1, inline), []

    def draw(node: Node, indent: str, top: bool, level: int) -> None:
        name = (f"{node.path}/" if node.path else "") if top else f"{node.name}/"
        while not top and len(node.dirs) == 1 and not node.files:
            node = next(iter(node.dirs.values()))
            name += f"{node.name}/"
        n_dirs, n_files = len(node.dirs), len(node.files)
        if not top:
            level += n_dirs > 1 or (n_dirs > 0 and n_files > 0) or n_files > 1
            if level >= depth:
                out.append(f"{indent}{name} {node.summary()}")
                return
        if not top or node.path:
            if not n_dirs and n_files <= inline:
                out.append(indent + name + ("  " + ", ".join(node.files) if n_files else ""))
                return
            out.append(indent + name)
        deeper = "" if top else indent + "  "
        for key in sorted(node.dirs, key=lambda x: x.encode()):
            draw(node.dirs[key], deeper, False, level)
        for at in range(0, n_files, inline):
            out.append(deeper + ", ".join(node.files[at : at + inline]))

    draw(root, "", True, 0)
    return out


def outline(files: DataFrame, subpath: str = "", depth: int = DEPTH, inline: int = INLINE, everything: bool = False, empty: list[str] | None = None) -> str:
    """The printed tree of files(file_path), with its size in a last line; empty names folders that need not have files."""
    p = F.col("file_path")
    top = subpath.strip("/")
    own = shown(files, everything)
    if top:
        own = own.where(F.startswith(p, F.lit(top + "/")))
    key = paths.natural_key(paths.base_name(p))
    rows = own.groupBy(paths.parent_dir(p).alias("folder")).agg(F.transform(F.sort_array(F.collect_list(key)), lambda k: paths.strip_known(k["name"])).alias("names"))
    found = [(r["folder"], r["names"]) for r in rows.collect()] + [(f, []) for f in empty or []]
    lines = ["# Project Structure", "", *drawn(built(found, top), depth, inline)]
    body = "\n".join(lines)
    n = len(body.encode())
    return f"{body}\n\n# ~{-(-n // 4)} tokens ({n} chars, {len(lines)} lines)\n"

"""Names of functions with that of the function around them, and their roll-ups by file and folder.

The function around another is the one with the fewest lines that contains its lines, the
first of several; on one line two functions so contain each other.  Only one level is named.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import paths

_FEW = 48


def _around(spans: list[tuple[int, int]]) -> list[int]:
    """For each span the shortest other one that contains it, the first of several, or -1."""
    n = len(spans)
    if n <= _FEW:
        out = []
        for i, (s, e) in enumerate(spans):
            best = min(((b - a, j) for j, (a, b) in enumerate(spans) if j != i and a <= s and b >= e), default=(0, -1))
            out.append(best[1])
        return out
    # sweep by start; a Fenwick tree over ends, the greatest first, keeps the two best spans so far
    ends = sorted({e for _, e in spans}, reverse=True)
    at = {e: k + 1 for k, e in enumerate(ends)}
    none = (1 << 62, -1)
    tree = [(none, none)] * (len(ends) + 1)
    out, order, k = [-1] * n, sorted(range(n), key=lambda i: spans[i][0]), 0
    for i in order:
        while k < n and spans[order[k]][0] <= spans[i][0]:
            j = order[k]
            new, p = (spans[j][1] - spans[j][0], j), at[spans[j][1]]
            while p <= len(ends):
                a, b = tree[p]
                tree[p] = (new, a) if new < a else (a, min(b, new))
                p += p & -p
            k += 1
        best, p = none, at[spans[i][1]]
        while p:
            a, b = tree[p]
            best = min(best, b if a[1] == i else a)
            p -= p & -p
        out[i] = best[1]
    return out


def dotted(functions: list[dict]) -> list[str]:
    """functions with name, line and line_end, in order: their distinct dotted names, sorted by bytes."""
    named = [f for f in functions if f["name"] is not None]
    around = _around([(f["line"], f["line_end"]) for f in named])
    names = {(f"{named[p]['name']}.{f['name']}" if p >= 0 else f["name"]) for f, p in zip(named, around, strict=True)}
    return sorted(names, key=str.encode)


def dotted_names(functions: Column) -> Column:
    """dotted() of an array of functions."""

    @F.arrow_udf("array<string>")
    def names(arrays: pa.Array) -> pa.Array:
        return pa.array([None if f is None else dotted(f) for f in arrays.to_pylist()], pa.list_(pa.string()))

    return names(functions)


def by_file(functions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, functions, names) from functions(path, ordinal, name, line, line_end).

    functions counts all, those without name too.  Files without any have a row if files(path) is given.
    """
    part = F.struct("ordinal", "name", "line", "line_end")
    out = functions.groupBy("path").agg(F.sort_array(F.collect_list(part)).alias("f"))
    out = out.select("path", F.size("f").cast("long").alias("functions"), dotted_names(F.col("f")).alias("names"))
    if files is None:
        return out
    none = F.array().cast("array<string>")
    return files.select("path").distinct().join(out, "path", "left").select("path", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("names", none).alias("names"))


def by_folder(files: DataFrame) -> DataFrame:
    """(folder, functions, names) from by_file()'s rows: the sum, and the sorted union of the names."""
    rows = files.select(paths.parent_dir(F.col("path")).alias("folder"), "functions", "names")
    return rows.groupBy("folder").agg(
        F.sum("functions").alias("functions"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")
    )

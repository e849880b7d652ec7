"""Nearest neighbours: a permutation index, and an exact pivot-distance index.

Both work on a table (id, vector).  All rows are indexed; the queries are all rows, or,
with `every`, those whose id it divides, each against all others.  Distances are
Euclidean, computed in double precision; ties go to the lesser id.

No task holds more than a block of queries and a block of vectors.  Blocks are cut by
their rows at every size of table, and a query goes just to the blocks that it may have
a partner in.

Defined results: rows with a null id, and null, empty or non-finite vectors (null
elements too), are neither queries nor partners, nor are vectors of another length
than the most frequent one (the least of several such); of rows that repeat an id the
least vector counts; a vector is never its own partner, but equal vectors with other
ids are, at distance 0; where there are fewer than k others, all are given; an empty
table has no neighbours.  Other columns are not looked at, texts among them, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.store import written

K, SEED = 10, 11
PIVOTS, LENGTH, POST, PROBE, SHARE, LEAST, LEVELS = 256, 128, 8, 28, 0.15, 128, 8
SIDE = 65_536  # queries that a task holds
SHARD_ROWS, GROUP_ROWS = 4096, 4096  # vectors that a task holds: a shard of an inverted file, a group of annuli
BINS, SALTS = 32, 64
FOUND = "id long, partners array<struct<distance:double,id:long>>"
_TYPE = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())]))


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one finite vector of the usual length for each id, as written table."""
    v = F.col(f"`{vector_col}`").cast("array<float>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & ok)
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = usual[0]["d"] if usual else 1
    return written(rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "vectors")


def _least(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 least ids of each vector.

    No others can be partners, as k with lesser ids stand at the same distance: thousands
    of equal vectors cost as many queries, but not as many pairs.  Salted first, so that
    one vector may be most of the rows.
    """
    v = [F.xxhash64("v"), F.col("v")]
    for part in ([*v, F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(SALTS))], v):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    return rows


def _asked(rows: DataFrame, every: int) -> DataFrame:
    return rows.where(F.pmod("id", F.lit(every)) == 0)


def _of(values: list[int], index: Column) -> Column:
    """values[index] for an index column; values are as many as there are pivots or groups."""
    return F.element_at(F.lit([int(v) for v in values] or [1]), index + 1)


def _blocks(own: Column, n: Column) -> Column:
    """Which of n blocks a row is in, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(SEED), own), n).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def pivots(rows: DataFrame, n: int) -> np.ndarray:
    """n vectors picked by a hash of their ids."""
    got = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(n).collect()
    return np.array([r["v"] for r in got], dtype=np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all rows."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _slack(v: np.ndarray, r: np.ndarray, far: float) -> np.ndarray:
    """What radii r around v are widened by, so that rounding in _squares loses no partner; far: greatest norm of a pivot.

    A square is off by some eps * (|a|^2 + |b|^2) for each dimension, so near 0 a distance
    is off by the root of it.  Partners within r have norms up to |v| + r; a pivot that
    is much farther off has a distance that is right but for some eps of its norm.  Four
    distances meet in a comparison.
    """
    unit = (v.shape[1] + 4) * np.finfo(np.float64).eps
    return 4 * (math.sqrt(2 * unit) * (np.sqrt((v * v).sum(axis=1)) + r) + 4 * unit * far)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, pairwise, without cancellation."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _listed(ids: np.ndarray, row: np.ndarray, partner: np.ndarray, distance: np.ndarray) -> pa.Table:
    """One row of partners for each id that has some; row: index into ids, in order."""
    some, size = np.unique(row, return_counts=True)
    structs = pa.StructArray.from_arrays([pa.array(distance), pa.array(partner)], names=["distance", "id"])
    at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pa.table({"id": pa.array(ids[some]), "partners": pa.ListArray.from_arrays(at, structs).cast(_TYPE)})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all partners found: (id, partner, rank, distance)."""
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("partners")))), 1, k).alias("p"))
    return best.select("id", F.posexplode("p").alias("pos", "p")).select(
        "id", F.col("p.id").alias("partner"), (F.col("pos") + 1).alias("rank"), F.round("p.distance", 6).alias("distance")
    )


def permutations(v: np.ndarray, piv: np.ndarray, length: int) -> np.ndarray:
    """The pivots of each vector from the nearest, ties by number."""
    return np.argsort(_squares(v, piv), axis=1, kind="stable")[:, :length]


def prefixes(perm: np.ndarray, n_pivots: int, levels: int) -> np.ndarray:
    """(rows, levels * n_pivots) of 0 and 1: which pivots stand in the first 1/levels, 2/levels, ... of the places.

    The footrule distance of two permutations (a missing pivot stands behind the last
    place), with places counted in steps of length/levels, is a constant less twice the
    number of ones that both rows have; with a level for each place it is the exact one.
    """
    n, length = perm.shape
    out = np.zeros((n, levels, n_pivots), dtype=np.uint8)
    for t in range(levels):
        own = perm[:, : -(-length * (t + 1) // levels)]
        np.put_along_axis(out[:, t], own, 1, 1)
    return out.reshape(n, -1)


def _overlap(a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """Common ones of all rows of a and b; the sums are exact in single precision."""
    left = a.astype(np.float32)
    return np.concatenate([left @ b[i : i + block].astype(np.float32).T for i in range(0, len(b), block)], axis=1)


@dataclass(frozen=True)
class Permutations:
    """Parameters of the index: prefix length, files a vector is posted in, files a query looks in, share reranked, steps of the footrule."""

    length: int = LENGTH
    post: int = POST
    probe: int = PROBE
    share: float = SHARE
    least: int = LEAST
    levels: int = LEVELS


def _search_file(piv: np.ndarray, par: Permutations, k: int, queries: pa.Table, posts: pa.Table) -> pa.Table:
    """Partners of the queries from one pivot's file: the best by footrule, reranked by distance."""
    qi, pi = (np.array(t.column("id")) for t in (queries, posts))
    if not qi.size or not pi.size:
        return _listed(qi, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    q, x = (_matrix(t.column("v").combine_chunks()) for t in (queries, posts))
    order = np.argsort(pi, kind="stable")
    pi, x = pi[order], x[order]
    levels = min(par.levels, par.length)
    wx = prefixes(permutations(x, piv, par.length), len(piv), levels)
    take = min(len(pi), max(par.least, math.ceil(par.share * len(pi))))
    rows, partners, dists = [], [], []
    step = max(1, (1 << 22) // len(pi))
    for at in range(0, len(qi), step):
        part = q[at : at + step]
        near = _overlap(prefixes(permutations(part, piv, par.length), len(piv), levels), wx)
        bound = np.partition(near, len(pi) - take, axis=1)[:, len(pi) - take]
        square = _squares(part, x)
        square[near < bound[:, None]] = np.inf  # ties in footrule distance stay
        square[qi[at : at + step, None] == pi[None]] = np.inf
        last = np.partition(square, min(k, len(pi)) - 1, axis=1)[:, min(k, len(pi)) - 1]
        i, j = np.nonzero((square <= last[:, None] + 1e-9) & np.isfinite(square))
        rows.append(at + i)
        partners.append(pi[j])
        dists.append(_exact(part[i], x[j]))
    return _listed(qi, np.concatenate(rows), np.concatenate(partners), np.concatenate(dists))


def permutation_search(
    table: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = K,
    n_pivots: int = PIVOTS,
    par: Permutations | None = None,
    every: int = 1,
    shard_rows: int = SHARD_ROWS,
    side: int = SIDE,
) -> DataFrame:
    """(id, partner, rank, distance): about the k nearest partners of every query.

    A vector stands in the inverted files of its `post` nearest pivots; as a query it
    looks into those of its `probe` nearest.  A file is cut, by a hash of the id, into
    shards of about shard_rows posts.  In a shard the footrule distance of the
    permutations ranks all posts, and the best `share` (`least` at any rate, and
    ties) are reranked by their distance.
    """
    rows = clean(table, id_col, vector_col)
    piv = pivots(rows, n_pivots)
    if not len(piv):
        return _ranked(table.sparkSession.createDataFrame([], FOUND), k)
    want = par or Permutations()
    par = Permutations(min(want.length, len(piv)), min(want.post, max(1, len(piv) // 2)), min(want.probe, len(piv)), want.share, want.least, want.levels)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                perm = permutations(_matrix(b.column(1)), piv, max(par.post, par.probe)).astype(np.int32)
                flat = pa.ListArray.from_arrays(np.arange(0, perm.size + 1, perm.shape[1], dtype=np.int32), pa.array(perm.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["id", "v", "near"])

    def filed(rows: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, list[int]]:
        """The files (id, v, pivot) of the n nearest pivots, and how many blocks each has."""
        files = written(rows.mapInArrow(near, "id long, v array<float>, near array<int>").select("id", "v", F.explode(F.slice("near", 1, n)).alias("pivot")), "files")
        blocks = [1] * len(piv)
        for r in files.groupBy("pivot").agg(F.count("*").alias("n")).collect():
            blocks[r["pivot"]] = math.ceil(r["n"] / block_rows)
        return files, blocks

    posts, shards = filed(_least(rows, k), par.post, shard_rows)
    asks, parts = filed(_asked(rows, every), par.probe, side)
    n_shards, n_parts = _of(shards, F.col("pivot")), _of(parts, F.col("pivot"))
    posts = posts.select("id", "v", "pivot", _blocks(F.col("id"), n_shards).alias("shard"), _every(n_parts).alias("part"))
    asks = asks.select("id", "v", "pivot", _every(n_shards).alias("shard"), _blocks(F.col("id"), n_parts).alias("part"))
    key = ["pivot", "shard", "part"]
    found = (
        asks.groupBy(*key).cogroup(posts.groupBy(*key))
        .applyInArrow(lambda a, b: _search_file(piv, par, k, a, b), FOUND)
    )
    return _ranked(found, k)


def _cells(batches: Iterator[pa.RecordBatch], piv: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            d = _squares(_matrix(b.column(1)), piv)
            cell = d.argmin(axis=1)
            key = np.sqrt(d[np.arange(len(d)), cell])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(key)], names=["id", "v", "cell", "key"])


def _bound(queries: pa.Table, table: pa.Table, k: int, far: float = 0.0) -> pa.Table:
    """The queries of one block, each with the distance to its k-th neighbour among the vectors there."""
    if not queries.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float32())), "r": pa.array([], pa.float64())})
    v, ids = _matrix(queries.column("v").combine_chunks()), np.array(queries.column("id"))
    out = np.full(len(v), np.inf)
    if table.num_rows > k:
        x, own = _matrix(table.column("v").combine_chunks()), np.array(table.column("id"))
        step = max(1, (1 << 22) // len(x))
        for i in range(0, len(v), step):
            d = _squares(v[i : i + step], x)
            d[ids[i : i + step, None] == own[None]] = np.inf
            out[i : i + step] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
    return queries.select(["id", "v"]).append_column("r", pa.array(out + _slack(v, out, far)))


@dataclass(frozen=True)
class Cells:
    """Pivots, and annuli: the cell, the least and greatest key and the group of each; groups are numbered, with `sizes` rows."""

    piv: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    group: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, piv: np.ndarray, stats: list[tuple[int, int, float, float, int]], group_rows: int) -> Cells:
        """stats: (cell, bin, least key, greatest key, rows), of which neighbours share a group up to group_rows."""
        annuli: list[list] = []
        sizes: list[int] = []
        for cell, _, low, high, n in sorted(stats):
            if not sizes or sizes[-1] + n > group_rows:
                sizes.append(0)
            sizes[-1] += n
            if annuli and annuli[-1][0] == cell and annuli[-1][3] == len(sizes) - 1:
                annuli[-1][2] = high + 1e-9
            else:
                annuli.append([cell, low - 1e-9, high + 1e-9, len(sizes) - 1])
        cell, low, high, group = (np.array(x) for x in zip(*annuli, strict=True)) if annuli else (np.zeros(0, np.int64),) * 4
        return cls(piv, cell.astype(np.int64), low, high, group.astype(np.int64), np.array(sizes, dtype=np.int64))

    def reached(self, d: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Which annuli may hold a vector within r of vectors with distances d to the pivots.

        By the triangle inequality on the annulus's keys, and on the border between the
        nearest pivot's cell and this one.
        """
        own = d[:, self.cell]
        return (own - r[:, None] <= self.high) & (own + r[:, None] >= self.low) & ((own - d.min(axis=1, keepdims=True)) / 2 <= r[:, None])

    def home(self, d: np.ndarray) -> np.ndarray:
        """The group of the annulus in the nearest filled cell whose keys are the least off."""
        filled = np.unique(self.cell)
        out = np.zeros(len(d), dtype=np.int32)
        nearest = filled[d[:, filled].argmin(axis=1)] if filled.size else out
        for c in np.unique(nearest):
            own, i = np.flatnonzero(self.cell == c), np.flatnonzero(nearest == c)
            key = d[i, c][:, None]
            out[i] = self.group[own[np.maximum(self.low[own] - key, key - self.high[own]).argmin(axis=1)]]
        return out


def _homes(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            home = cells.home(np.sqrt(_squares(_matrix(b.column(1)), cells.piv)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home)], names=["id", "v", "grp"])


def _route(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Each query once for every group with an annulus that it reaches."""
    for b in batches:
        for at in range(0, len(b), step := max(1, (1 << 22) // max(1, cells.cell.size))):
            part = b.slice(at, step)
            hit = cells.reached(np.sqrt(_squares(_matrix(part.column(1)), cells.piv)), np.array(part.column(2)))
            # annuli lie in order of their groups
            heads = np.searchsorted(cells.group, np.arange(cells.sizes.size))
            row, group = np.nonzero(np.logical_or.reduceat(hit, heads, axis=1)) if heads.size else (np.zeros(0, np.int64),) * 2
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(group.astype(np.int32))], names=["id", "v", "r", "grp"])


def _expand(piv: np.ndarray, k: int, shell: int, queries: pa.Table, data: pa.Table) -> pa.Table:
    """Exact partners within one group of cells, annulus by annulus."""
    qi = np.array(queries.column("id"))
    none = np.zeros(0, np.int64)
    if not qi.size or not data.num_rows:
        return _listed(qi, none, none, np.zeros(0))
    q, r = _matrix(queries.column("v").combine_chunks()), np.array(queries.column("r")).copy()
    data = data.sort_by([("cell", "ascending"), ("key", "ascending"), ("id", "ascending")])
    xi, x, cell, key = np.array(data.column("id")), _matrix(data.column("v").combine_chunks()), np.array(data.column("cell")), np.array(data.column("key"))
    far = float(np.sqrt((piv**2).sum(axis=1)).max())
    best = np.full((len(q), k), np.inf)
    to_pivot: dict[int, np.ndarray] = {c: np.sqrt(_squares(q, piv[[c]]))[:, 0] for c in np.unique(cell)}
    nearest = np.sqrt(_squares(q, piv)).min(axis=1)
    annuli = []
    for c in np.unique(cell):
        a, b = np.searchsorted(cell, [c, c + 1])
        annuli += [(int(c), i, min(i + shell, int(b))) for i in range(int(a), int(b), shell)]
    gap = np.stack([np.maximum(np.maximum(key[a] - to_pivot[c], to_pivot[c] - key[b - 1]), (to_pivot[c] - nearest) / 2) for c, a, b in annuli], axis=1)
    rows, cols, dist = [], [], []
    # nearest annuli first; a query drops out of an annulus whose bound is beyond its k-th partner so far
    order = np.argsort(gap, axis=1, kind="stable")
    for turn in range(len(annuli)):
        live = np.flatnonzero(gap[np.arange(len(q)), order[:, turn]] <= r)
        if not live.size:
            break
        for s in np.unique(order[live, turn]):
            i = live[order[live, turn] == s]
            _, a, b = annuli[s]
            d = np.sqrt(_squares(q[i], x[a:b]))
            d[qi[i, None] == xi[None, a:b]] = np.inf
            near = (d <= r[i, None]) & np.isfinite(d)
            some = near.any(axis=1)
            if not some.any():
                continue
            i, d, near = i[some], d[some], near[some]
            u, w = np.nonzero(near)
            rows.append(i[u])
            cols.append(a + w)
            dist.append(d[u, w])
            best[i] = np.partition(np.concatenate([best[i], d], axis=1), k - 1, axis=1)[:, :k]
            last = best[i].max(axis=1)
            r[i] = np.minimum(r[i], last + _slack(q[i], last, far))
    if not rows:
        return _listed(qi, none, none, np.zeros(0))
    u, w, d = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
    keep = d <= r[u]
    u, w = u[keep], w[keep]
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    return _listed(qi, u, xi[w], _exact(q[u], x[w]))


def exact_search(
    table: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = K,
    n_pivots: int | None = None,
    group_rows: int = GROUP_ROWS,
    shell: int = 256,
    every: int = 1,
    side: int = SIDE,
) -> DataFrame:
    """(id, partner, rank, distance): exactly the k nearest partners of every query.

    Vectors are keyed by nearest pivot and distance to it; there are half as many pivots
    as the root of the vectors, unless n_pivots says otherwise.  Annuli of cells make groups of about group_rows
    vectors, in shards where an annulus alone has more.  The k-th neighbour within the
    group nearest by key bounds a query's radius; it then goes to the groups that the
    triangle inequality leaves, where annuli of keys are expanded from the nearest on
    until their bound is beyond the k-th partner found.
    """
    rows = clean(table, id_col, vector_col)
    n = rows.count()
    piv = pivots(rows, max(1, min(n_pivots or round(math.sqrt(n) / 2), n)))
    if not len(piv):
        return _ranked(table.sparkSession.createDataFrame([], FOUND), k)
    keyed = written(_least(rows, k).mapInArrow(lambda it: _cells(it, piv), "id long, v array<float>, cell int, key double"), "keyed")
    # a row for each pivot, then one for each bin of a pivot's keys
    ends = {r["cell"]: (r["low"], r["high"]) for r in keyed.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()}
    low = F.element_at(F.lit([float(ends.get(c, (0, 0))[0]) for c in range(len(piv))]), F.col("cell") + 1)
    wide = F.element_at(F.lit([float(ends[c][1] - ends[c][0]) or 1.0 if c in ends else 1.0 for c in range(len(piv))]), F.col("cell") + 1)
    keyed = keyed.withColumn("bin", F.least(F.floor((F.col("key") - low) / wide * BINS), F.lit(BINS - 1)).cast("int"))
    stats = keyed.groupBy("cell", "bin").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).collect()
    cells = Cells.of(piv, [tuple(r) for r in stats], group_rows)
    far = float(np.sqrt((piv**2).sum(axis=1)).max(initial=0))
    shards = _of([math.ceil(s / group_rows) for s in cells.sizes], F.col("grp"))
    # the group of a vector is that of its bin
    at: dict[tuple[int, int], int] = {}
    for c, b, lo, *_ in stats:
        own = np.flatnonzero(cells.cell == c)
        at[c, b] = int(cells.group[own[np.searchsorted(cells.low[own], lo, side="right") - 1]])
    grp = F.element_at(F.lit([at.get((c, b), 0) for c in range(len(piv)) for b in range(BINS)]), F.col("cell") * BINS + F.col("bin") + 1)
    data = keyed.select("id", "v", "cell", "key", grp.cast("int").alias("grp"))
    data = data.withColumn("shard", _blocks(F.col("id"), shards))

    def blocks(asks: DataFrame) -> list[int]:
        """How many blocks of queries each group has."""
        out = [1] * len(cells.sizes)
        for r in asks.groupBy("grp").agg(F.count("*").alias("n")).collect():
            out[r["grp"]] = math.ceil(r["n"] / side)
        return out

    key = ["grp", "shard", "part"]

    def met(asks: DataFrame, shard: Column, work, schema: str) -> DataFrame:  # noqa: ANN001
        parts = _of(blocks(asks), F.col("grp"))
        asks = asks.withColumn("shard", shard).withColumn("part", _blocks(F.col("id"), parts))
        return asks.groupBy(*key).cogroup(data.withColumn("part", _every(parts)).groupBy(*key)).applyInArrow(work, schema)

    homes = written(_asked(rows, every).mapInArrow(lambda it: _homes(it, cells), "id long, v array<float>, grp int"), "homes")
    bound = met(homes, F.lit(0), lambda a, b: _bound(a, b, k, far), "id long, v array<float>, r double")
    asks = written(bound.mapInArrow(lambda it: _route(it, cells), "id long, v array<float>, r double, grp int"), "asks")
    return _ranked(met(asks, _every(shards), lambda a, b: _expand(piv, k, shell, a, b), FOUND), k)


def sql(every: int = 1) -> str:
    """The exact search in DuckDB over embeddings."""
    return f"""
WITH e AS (
  SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1
), r AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0
), k AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM r
)
SELECT vec_id, neighbour_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM k WHERE rank <= {K}
"""

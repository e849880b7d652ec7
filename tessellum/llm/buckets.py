"""Links of a similarity join by buckets, without lists of pairs.

A node (a distinct text) has a number of keys; nodes that share a key are candidates.
What is wanted are the groups that candidates connect which turn out to be similar, and
for that a bucket of n nodes seldom needs n * n comparisons:

* stars(): every node of a bucket is paired with its lead, the least node.  Buckets are
  combined within a batch before anything is shuffled, so a key that a third of all
  nodes share costs a row for each batch, and its members meet the lead of their batch.
  Spark shuffles rows that hold all of a part of the keys, see packed(), not a row for each key.
* rest(): buckets whose nodes are not in one group after that are looked at again.  The
  nodes outside of the bucket's largest group are cut into blocks, and meet all nodes of
  the bucket but those of their own group, which are cut into spans: a task holds a block
  and a span, whatever the bucket's size.  Where few pairs are candidates, FEW for each
  node at most, they are listed, so that one of several buckets is compared but once; where there are more,
  they are compared on the spot, and a link is given only where it joins two groups.

Between them every pair of candidates was either compared or is in one group already:
groups are just those of all similar candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.components import connected
from tessellum.llm.store import written
from tessellum.llm.text import mix

BLOCK, SPAN, STEP, FEW = 2048, 16_384, 1 << 12, 8
HELD_BYTES = 16 << 20  # of pairs that are compared at a time
SMALL = 100_000  # keys that are broadcast, at 8 bytes each
PARTS, HELD_POSTS = 16, 1 << 20  # parts of a table for each of its shuffle partitions, posts that are packed at a time
PACKED = "part int, key binary, node binary, mark binary, n binary, home binary, member binary, lead binary, near binary"
STAR = "key long, a long, b long, near boolean, alone boolean"
SIDES = "key long, block int, span int, node long, mark long, grp long, side int, other long"
MAJOR, OTHER, BLOCK_SIDE = 0, 1, 2  # sides: of the largest group, of another one, and of the latter as a member of a block
Compare = Callable[[pa.Array], Callable[[np.ndarray, np.ndarray], np.ndarray]]


class Near(NamedTuple):
    """In the lowest `bits` bits of marks `distance` differ at most; the bits above are numbers in a round, `apart` steps apart at most."""

    distance: int
    bits: int = 64
    apart: int = 0

    def sketch(self, mark: np.ndarray) -> np.ndarray:
        return mark << (64 - self.bits)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits == 64:
            return np.ones(a.size, dtype=bool)
        return ((a >> self.bits) - (b >> self.bits) + self.apart & (1 << 64 - self.bits) - 1) <= 2 * self.apart


def _near(a: np.ndarray, b: np.ndarray, distance: int | Near) -> np.ndarray:
    near = distance if isinstance(distance, Near) else Near(distance)
    return (np.bitwise_count(near.sketch(a ^ b).view(np.uint64)) <= near.distance) & near.fits(a, b)


def _rows(key: np.ndarray, node: np.ndarray, mark: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, ...] = ()) -> pa.RecordBatch:
    none = [pa.nulls(key.size, pa.int64()), pa.nulls(key.size, pa.int64()), pa.nulls(key.size, pa.bool_())]
    return pa.RecordBatch.from_arrays([*map(pa.array, (key, node, mark, n)), *(map(pa.array, pairs) if pairs else none)], names=["key", "node", "mark", "n", "home", "lead", "near"])


def n_parts(df: DataFrame) -> int:
    return PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which part an evenly spread uint64 belongs to; parts are in order of the values."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def packed(parts: int, groups: list[tuple[np.ndarray, dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]]]) -> pa.RecordBatch:
    """A row for each part that has something: its number and, for each column, its values side by side as bytes.

    groups: the parts of values, in order, and columns of such values, or of (bytes, where values begin).
    """
    bounds = [np.searchsorted(part, np.arange(parts + 1)) for part, _ in groups]
    some = np.flatnonzero(np.any([np.diff(b) > 0 for b in bounds], axis=0))
    names, out = ["part"], [pa.array(some.astype(np.int32))]
    for (_, columns), bound in zip(groups, bounds, strict=True):
        at = np.append(bound[some], bound[-1])
        for name, x in columns.items():
            data, cut = (x[0], x[1][at]) if isinstance(x, tuple) else (x, at * x.itemsize)
            data = pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))
            names.append(name)
            out.append(pa.Array.from_buffers(pa.binary(), some.size, [None, pa.py_buffer(cut.astype(np.int32)), data]))
    return pa.RecordBatch.from_arrays(out, names=names)


def _flat(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column."""
    column = column.cast(pa.large_binary())
    cut = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[cut[0] : cut[-1]].copy() if data is not None else np.zeros(0, np.uint8)


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """The columns of packed rows that are sorted by part, whole parts at a time."""
    for rows, _ in _runs(batches, 1):
        yield [_flat(column).view(kind) for column, kind in zip(rows.columns[1:], kinds, strict=True)]


def _posts(batches: Iterator[pa.RecordBatch], distance: int | Near) -> Iterator[pa.RecordBatch]:
    """For each key of a batch its lead and the number of its nodes, and the pairs of the others with the lead."""
    for batch in batches:
        keys = batch.column(2)
        size = np.array((pc.binary_length(keys) if pa.types.is_binary(keys.type) else keys.value_lengths()).fill_null(0), dtype=np.int64)
        if not size.sum():
            continue
        if pa.types.is_binary(keys.type):
            key, size = _flat(keys).view(np.int64), size // 8
        else:
            key = keys.flatten().to_numpy(zero_copy_only=False)
        node, mark = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), size) for i in (0, 1))
        order = np.lexsort((node, key))
        key, node, mark = key[order], node[order], mark[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(head)[np.cumsum(head) - 1]
        own = ~head & (node != node[at])
        n = np.add.reduceat((head | own).astype(np.int64), np.flatnonzero(head))
        yield _rows(key[head], node[head], mark[head], n)
        if own.any():  # they go anywhere but to the key's place
            yield _rows(node[own], node[own], mark[own], np.ones(int(own.sum()), np.int64), (key[own], node[at][own], _near(mark[own], mark[at][own], distance)))


def _packed_posts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What _posts() gives, as packed rows."""

    def flush() -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        done = np.array(rows.column(5).is_valid())
        posts, pairs = rows.filter(pa.array(~done)), rows.filter(pa.array(done))
        key, node, mark, n = (posts.column(i).to_numpy() for i in range(4))
        # keys and, as pairs may be anywhere, their nodes are mixed again: keys need not be spread evenly
        groups = []
        for name, columns in ((key, {"key": key, "node": node, "mark": mark, "n": n}), (pairs.column(1).to_numpy(), {k: pairs.column(i).to_numpy(zero_copy_only=False) for k, i in (("home", 4), ("member", 1), ("lead", 5), ("near", 6))})):
            part = part_of(mix(name.view(np.uint64)), parts)
            order = np.argsort(part, kind="stable")
            groups.append((part[order], {k: v[order] for k, v in columns.items()}))
        groups[0][1]["n"] = np.minimum(groups[0][1]["n"], 3).astype(np.int8)  # asked is whether they are two
        return packed(parts, groups)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= HELD_POSTS:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _unpacked_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _leads() takes: all posts of keys that have several, in order, and the pairs."""
    for key, node, mark, n, home, member, lead, near in unpacked(batches, [np.int64, np.int64, np.int64, np.int8, np.int64, np.int64, np.int64, np.bool_]):
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        some = order[np.append(same, False) | np.append(False, same)] if key.size else order
        some = some[np.lexsort((node[some], key[some]))]
        yield _rows(key[some], node[some], mark[some], n[some].astype(np.int64))
        if member.size:
            yield _rows(member, member, member, np.ones(member.size, np.int64), (home, lead, near))


def _leads(batches: Iterator[pa.RecordBatch], distance: int | Near) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes with the lead of their run; runs are sorted by key and node and may span batches."""

    def stars(key: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (key, a, b, near, alone))], names=["key", "a", "b", "near", "alone"])

    last: tuple[int, ...] | None = None
    for batch in batches:
        done = np.array(batch.column(5).is_valid())
        if done.any():
            some = batch.filter(pa.array(done))
            yield pa.RecordBatch.from_arrays([some.column(4), some.column(1), some.column(5), some.column(6), pa.array(np.zeros(len(some), bool))], names=["key", "a", "b", "near", "alone"])
            batch = batch.filter(pa.array(~done))
        key, node, mark, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not key.size:
            continue
        if last is not None:
            key, node, mark, n = (np.append(x, y) for x, y in zip(last, (key, node, mark, n), strict=True))
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(head)
        at = first[np.cumsum(head) - 1]
        two = np.add.reduceat(n, first) == 2
        two[[0, -1]] = False  # these runs may go on in other batches
        own = node != node[at]
        if own.any():
            lead = at[own]
            yield stars(key[own], node[own], node[lead], _near(mark[own], mark[lead], distance), np.repeat(two, np.diff(np.append(first, key.size)))[own])
        last = key[at[-1]], node[at[-1]], mark[at[-1]], 2


def stars(nodes: DataFrame, distance: int | Near) -> DataFrame:
    """(key, a, b, near, alone): each node of nodes(node, mark, keys) with leads of its buckets.

    near: whether marks differ in `distance` bits at most; alone: the bucket has no third node (never said of some that have none).
    """
    parts = n_parts(nodes)
    return (
        nodes.select("node", "mark", "keys")
        .mapInArrow(lambda it: _packed_posts(_posts(it, distance), parts), PACKED)
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(lambda it: _leads(_unpacked_posts(it), distance), STAR)
    )


def split_buckets(found: DataFrame, marks: DataFrame, groups: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame | None:
    """(key, block, span, node, mark, grp, side, other) of the buckets that hold several groups; None if there are none.

    found: what stars() gives; marks: (node, mark); groups: (node, root).
    """
    rows = found.where("not alone").select("key", "a", "b")
    for side in ("a", "b"):
        rows = rows.join(groups.select(F.col("node").alias(side), F.col("root").alias("root_" + side)), side, "left")
    rows = written(rows.select("key", "a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")), "rows")
    keys = written(rows.where("x <> y").select("key").distinct(), "keys")
    n_keys = keys.count()
    if not n_keys:
        return None
    rows = rows.join(F.broadcast(keys) if n_keys <= SMALL else keys, "key")
    posts = rows.select("key", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("grp")), F.struct(F.col("b").alias("node"), F.col("y").alias("grp")))).alias("p"))
    posts = written(posts.select("key", "p.*").join(marks, "node").select("key", "node", "mark", "grp").distinct(), "posts")
    sizes = posts.groupBy("key", "grp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("grp", F.struct("n", "grp")).alias("most"), F.max("n").alias("top"), F.sum("n").alias("n"))
    # a bucket of two was compared by its star
    sizes = sizes.where("n > 2 and top < n").select("key", "most", F.ceil((F.col("n") - F.col("top")) / block).cast("int").alias("blocks"), F.ceil(F.col("n") / span).cast("int").alias("spans"))
    rows = posts.join(sizes, "key")
    own = F.xxhash64("node")
    parts = F.array(
        F.struct(F.when(F.col("grp") != F.col("most"), OTHER).otherwise(MAJOR).alias("side"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("block"), F.array(F.pmod(own, F.col("spans")).cast("int")).alias("span")),
        F.when(F.col("grp") != F.col("most"), F.struct(F.lit(BLOCK_SIDE).alias("side"), F.array(F.pmod(own, F.col("blocks")).cast("int")).alias("block"), F.sequence(F.lit(0), F.col("spans") - 1).alias("span"))),
    )
    rows = rows.select("key", "node", "mark", "grp", F.explode(parts).alias("p")).where("p is not null")
    return rows.select("key", F.explode("p.block").alias("block"), "p.span", "node", "mark", "grp", "p.side").select(
        "key", "block", F.explode("span").alias("span"), "node", "mark", "grp", "side", F.lit(None).cast("long").alias("other")
    )


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int = 3) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in whole runs of their first columns, and where the runs begin (n + 1 values)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        now = pa.concat_batches(held)
        keys = [now.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if new.size:
            yield now.slice(0, new[-1]), np.concatenate([[0], new])
            now = now.slice(new[-1])
        held = [now]
    if held:
        yield held[0], np.array([0, len(held[0])])


def _candidates(a: int, b: int, node: np.ndarray, mark: np.ndarray, grp: np.ndarray, side: np.ndarray, distance: int | Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a run, a block's row first, of different groups and with near marks; two rows of blocks meet but once."""
    x, y = a + np.flatnonzero(side[a:b] == BLOCK_SIDE), a + np.flatnonzero(side[a:b] != BLOCK_SIDE)
    size = max(1, (1 << 20) // max(1, y.size))
    near = distance if isinstance(distance, Near) else Near(distance)
    sketch = near.sketch(mark).view(np.uint64)
    for at in range(0, x.size, size):
        part = x[at : at + size]
        ok = (np.bitwise_count(sketch[part, None] ^ sketch[None, y]) <= near.distance) & (grp[part, None] != grp[None, y])
        ok &= (side[None, y] == MAJOR) | (node[part, None] > node[None, y])
        u, w = np.nonzero(ok)
        i, j = part[u], y[w]
        fits = near.fits(mark[i], mark[j])
        yield i[fits], j[fits]


def _within(batches: Iterator[pa.RecordBatch], distance: int | Near, few: int = FEW) -> Iterator[pa.RecordBatch]:
    """Pairs, in the columns node and other, of runs with few candidates; of other runs the rows that have one."""
    for rows, cut in _runs(batches):
        node, mark, grp, side = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
        keep, pairs = np.zeros(len(rows), dtype=bool), []
        for a, b in zip(cut, cut[1:], strict=False):
            own, n = [], 0
            for i, j in _candidates(a, b, node, mark, grp, side, distance):
                n += i.size
                if n <= few * (b - a):
                    own.append((i, j))
                keep[i] = keep[j] = True
            if n <= few * (b - a):
                keep[a:b] = False
                pairs += own
        if keep.any():
            yield rows.filter(pa.array(keep))
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            u, w = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
            none = [pa.nulls(u.size, t) for t in (pa.int64(), pa.int64(), pa.int32())]
            blank = [pa.array(np.zeros(u.size, np.int64)), *(pa.array(np.zeros(u.size, np.int32)) for _ in range(2))]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(u), *none, pa.array(w)], names=["key", "block", "span", "node", "mark", "grp", "side", "other"])


class _Groups:
    """Union by least name."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x in self.up:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.root(x), self.root(y)))
        if x == y:
            return False
        self.up[y] = x
        return True


def _links(batches: Iterator[pa.RecordBatch], distance: int | Near, compare: Compare, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Links that join groups of a run."""

    def work(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        while i.size:
            root = np.array([groups.root(g) for g in grp.tolist()]) if groups.up else grp
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            now, i, now_j, j = i[:step], i[step:], j[:step], j[step:]
            if not now.size:
                return
            ok = test(now, now_j)
            made = [(a, b) for a, b in zip(now[ok].tolist(), now_j[ok].tolist(), strict=True) if groups.join(int(grp[a]), int(grp[b]))]
            if made:
                a, b = (np.array(x) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    for rows, cut in _runs(batches):
        node, mark, grp, side = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
        groups, test = _Groups(), compare(rows.column(7))
        for a, b in zip(cut, cut[1:], strict=False):
            for i, j in _candidates(a, b, node, mark, grp, side, distance):
                yield from work(i, j)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: pairs of like size are compared side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= HELD_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _tested(batches: Iterator[pa.RecordBatch], compare: Compare) -> Iterator[pa.RecordBatch]:
    for batch in _joined(batches):
        if n := len(batch):
            ok = compare(pa.concat_arrays([batch.column(2), batch.column(3)]))(np.arange(n), np.arange(n, 2 * n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "ok"])


def grouped(
    nodes: DataFrame,
    distance: int | Near,
    values: Callable[[DataFrame], DataFrame],
    compare: Compare,
    block: int = BLOCK,
    span: int = SPAN,
    few: int = FEW,
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between similar nodes, and (node, root) of all nodes that have one.

    nodes(node, mark, keys) has to be a written table with a row for each node; keys are an
    array of 64-bit numbers, or their bytes side by side.  values
    gives (node, value) for a table of nodes; compare makes of an array of values the
    test whether rows i and j are similar.  distance: how many bits of the marks of candidates
    differ at most, or a Near.
    """
    found = written(stars(nodes, distance), "stars")
    wanted = found.where("near or not alone").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    value = values(wanted)

    def checked(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(value.select(F.col("node").alias(side), F.col("value").alias("value_" + side)), side)
        pairs = pairs.select("a", "b", "value_a", "value_b").mapInArrow(lambda it: _tested(it, compare), "a long, b long, ok boolean")
        return written(pairs, "checked")

    first = checked(found.where("near").select("a", "b").distinct())
    links = first.where("ok").select("a", "b")
    groups = connected(links)
    sides = split_buckets(found, nodes.select("node", "mark"), groups, block, span)
    if sides is not None:
        key = ["key", "block", "span"]
        sort = lambda df: df.repartition(*key).sortWithinPartitions(*key, "node")
        sides = written(sort(sides).mapInArrow(lambda it: _within(it, distance, few), SIDES), "sides")
        pairs = sides.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        more = checked(pairs.join(first.where("not ok"), ["a", "b"], "left_anti")).where("ok").select("a", "b")
        many = sides.where("other is null").drop("other")
        if many.limit(1).count():
            # a row stands for many comparisons: by a number, else so few bytes become a single task
            tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            many = many.join(value, "node").select(*key, "node", "mark", "grp", "side", "value").repartition(tasks, *key).sortWithinPartitions(*key, "node")
            more = more.unionByName(written(many.mapInArrow(lambda it: _links(it, distance, compare), "a long, b long").distinct(), "links"))
        links = links.unionByName(more)
        groups = connected(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return links, groups

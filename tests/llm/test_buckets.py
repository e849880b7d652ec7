"""Groups of buckets against all pairs, whatever the sizes of batches, blocks and spans."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellum.llm import buckets as b
from tessellum.llm.store import written


def close(x, y):
    return abs(x - y) <= 3


def by_value(values):
    value = np.array(values)
    return lambda i, j: np.abs(value[i] - value[j]) <= 3


def want(nodes, distance):
    up = {n: n for n, *_ in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, mark, keys, value in nodes:
        for m, other, own, v in nodes:
            if m < n and set(keys) & set(own) and (mark ^ other).bit_count() <= distance and close(v, value):
                x, y = sorted((find(n), find(m)))
                up[y] = x
    groups = {}
    for n in up:
        groups.setdefault(find(n), set()).add(n)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("block,span,few,seed", [(2048, 16384, 8, 1), (3, 5, 0, 2), (1, 2, 8, 3), (7, 1000, 1, 4)])
def test_groups_are_those_of_all_pairs(spark, block, span, few, seed):
    r = random.Random(seed)
    nodes = [(i, r.choice([0, 1, 3, 255]), sorted({r.choice([7, 7, r.randint(0, 30)]) for _ in range(r.randint(0, 3))}), r.randint(0, 250)) for i in range(160)]
    df = written(spark.createDataFrame(nodes, "node long, mark long, keys array<long>, value long").repartition(3), "nodes")
    values = df.select("node", "value")
    links, groups = b.grouped(df.drop("value"), 2, lambda wanted: values.join(wanted, "node", "left_semi"), by_value, block, span, few)
    found = {}
    for g in groups.collect():
        found.setdefault(g.root, set()).add(g.node)
    assert sorted(sorted(g) for g in found.values()) == want(nodes, 2)
    by = {n: x for n, *x in nodes}
    made = links.collect()
    assert all(close(by[x.a][2], by[x.b][2]) for x in made) and len(made) < 3 * len(nodes)


def test_a_bucket_costs_a_row_for_each_node(spark):
    """20,000 nodes under one key: no list of pairs."""
    n = 20_000
    df = written(spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("mark"), F.array(F.lit(5).cast("long"), F.col("id") + 100).alias("keys")), "nodes")
    assert b.stars(df, 0).count() == n - 1


def test_leads_of_runs_that_span_batches():
    key, node = np.array([1, 2, 2, 2, 3, 3]), np.arange(6)
    for cuts in ([], [2], [3], [2, 3], [1, 2, 3, 4, 5]):
        parts = [b._rows(key[x:y], node[x:y], node[x:y] * 0, node[x:y] * 0 + 1) for x, y in zip([0, *cuts], [*cuts, 6], strict=True)]
        got = [x for p in b._leads(iter(parts), 0) for x in zip(p.column(1).to_pylist(), p.column(2).to_pylist(), p.column(4).to_pylist(), strict=True)]
        assert sorted(x[:2] for x in got) == [(2, 1), (3, 1), (5, 4)]
        assert not any(alone for *_, alone in got[:2])
        runs = [rows.column(1).to_pylist()[x:y] for rows, cut in b._runs(iter(parts), 1) for x, y in zip(cut, cut[1:], strict=False)]
        assert runs == [[0], [1, 2, 3], [4, 5]]
    assert list(b._runs(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["key"])]), 1)) == []


@pytest.mark.parametrize("few", [8, 0])
def test_a_bucket_that_stays_apart_lists_no_pairs(spark, few, monkeypatch):
    """3,000 nodes under one key that are alike in threes: what is written stays in proportion to them."""
    n, sizes = 3000, {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(b, "written", counted)
    value = F.floor(F.col("id") / 3) * 10 + F.col("id") % 3
    df = written(spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("mark"), F.array(F.lit(5).cast("long")).alias("keys"), value.alias("value")), "nodes")
    _, groups = b.grouped(df.drop("value"), 0, lambda wanted: df.select("node", "value"), by_value, few=few)
    assert groups.count() == n and groups.select("root").distinct().count() == n // 3
    assert max(sizes.values()) < 10 * n


def test_posts_travel_by_parts():
    """Two batches of 20,000 nodes with 12 keys each: a row for each part, not for each key, and the same pairs."""
    r = np.random.default_rng(3)
    nodes, keys = np.arange(40_000), r.integers(-(1 << 63), 1 << 63, (40_000, 12))
    keys[1::4, 0] = keys[::4, 0]
    keys[::100, 1] = 7
    want = {(k, x) for k, x in zip(keys[1::4, 0].tolist(), nodes[1::4].tolist(), strict=True)} | {(7, x) for x in nodes[::100].tolist()[1:]}
    lists = [pa.array(list(keys)), pa.Array.from_buffers(pa.binary(), 40_000, [None, pa.py_buffer(np.arange(0, 40_001 * 96, 96, dtype=np.int32)), pa.py_buffer(keys)])]
    for own in lists:
        whole = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes * 0), own], names=["node", "mark", "keys"])
        rows = pa.concat_batches(list(b._packed_posts(b._posts(iter([whole.slice(0, 20_000), whole.slice(20_000)]), 0), 64)))
        assert len(rows) <= 64
        found = pa.concat_batches(list(b._leads(b._unpacked_posts(iter([rows.slice(0, 20), rows.slice(20)])), 0)))
        assert {(k, x) for k, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)} >= want
        assert len(found) <= len(want) + 1

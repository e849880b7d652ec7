import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessellum.llm import vectors as v
from tests.llm.cases import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(n, d=16, seed=1, centres=8):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, d)) * 1.5
    return (c[r.integers(0, centres, n)] + r.normal(size=(n, d))).astype(np.float32)


def brute(ids, x, k):
    x, out = x.astype(np.float64), {}
    for i, a in zip(ids, x, strict=True):
        d = sorted((math.sqrt(((a - b) ** 2).sum()), j) for j, b in zip(ids, x, strict=True) if j != i)[:k]
        out[i] = [(j, r + 1, round(y, 6)) for r, (y, j) in enumerate(d)]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["partner"], r["rank"], r["distance"]))
    return out


@pytest.mark.parametrize("pivots,group,shell", [(None, 4096, 256), (12, 60, 16), (1, 10, 5)])
def test_exact_search_agrees_with_brute_force(spark, pivots, group, shell):
    x = cloud(400)
    df = spark.createDataFrame([(i, a.tolist(), 0) for i, a in enumerate(x)], SCHEMA)
    got = lists(v.exact_search(df, "vec_id", "embedding", 7, pivots, group, shell))
    assert got == brute(range(400), x, 7)


def recall(got, want, k=10):
    return np.mean([len({a for a, *_ in got[i]} & {a for a, *_ in want[i]}) / k for i in want])


@pytest.mark.parametrize("every,side,shard", [(1, 100, 50), (20, 3, 20), (7, 65536, 4096)])
def test_searches_in_blocks(spark, every, side, shard):
    x = cloud(330, seed=4)
    df = spark.createDataFrame([(i - 50, a.tolist(), 0) for i, a in enumerate(x)], SCHEMA)
    want = {i: p for i, p in brute(range(-50, 280), x, 5).items() if i % every == 0}
    assert lists(v.exact_search(df, "vec_id", "embedding", 5, 10, shard, every=every, side=side)) == want
    got = lists(v.permutation_search(df, "vec_id", "embedding", 5, every=every, side=side, shard_rows=shard))
    assert got.keys() == want.keys() and recall(got, want, 5) > 0.9


def test_an_annulus_of_most_rows_is_sharded(spark):
    """400 vectors on a circle around the origin have one key; the others lie beyond."""
    r = np.random.default_rng(5)
    turn = np.sort(r.random(400)) * 2 * math.pi
    x = np.concatenate([[[0, 0]], np.column_stack([np.cos(turn), np.sin(turn)]), r.normal(size=(60, 2)) + 9]).astype(np.float32)
    df = spark.createDataFrame([(i, a.tolist(), 0) for i, a in enumerate(x)], SCHEMA)
    assert lists(v.exact_search(df, "vec_id", "embedding", 4, 1, 50, 16)) == brute(range(len(x)), x, 4)


@pytest.mark.parametrize("n,d", [(600, 16), (3000, 32)])
def test_recall_of_the_permutation_index(spark, n, d):
    x = cloud(n, d, seed=3)
    df = spark.createDataFrame([(i, a.tolist(), 0) for i, a in enumerate(x)], SCHEMA)
    got = lists(v.permutation_search(df, "vec_id", "embedding"))
    want = lists(v.exact_search(df, "vec_id", "embedding"))
    assert len(got) == n and all([r for _, r, _ in p] == list(range(1, 11)) for p in got.values())
    assert np.mean([len({a for a, *_ in got[i]} & {a for a, *_ in want[i]}) / 10 for i in want]) > 0.9


def test_footrule_from_common_prefixes():
    r, length = random.Random(1), 5
    for _ in range(50):
        a, b = (r.sample(range(9), length) for _ in range(2))
        place = lambda p, x: x.index(p) if p in x else length
        direct = sum(abs(place(p, a) - place(p, b)) for p in range(9))
        w = v.prefixes(np.array([a, b]), 9, length)
        assert direct == length * (length + 1) - 2 * int(v._overlap(w[:1], w[1:])[0, 0])


def test_awkward_vectors(spark):
    same = [0.5, 0.5]
    rows = [
        (1, same, 0), (2, same, 0), (3, same, 0), (4, [1.0, 0.0], 0), (5, None, 0), (6, [], 0), (7, [float("nan"), 1.0], 0), (8, [None, 1.0], 0),
        (None, [0.0, 0.0], 0), (9, [1.0, 2.0, 3.0], 0), (4, [1.0, 0.0], 0), (4, [2.0, 0.0], 1), (10, [float("inf"), 0.0], 0),
    ]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    want = brute([1, 2, 3, 4], np.array([same, same, same, [1.0, 0.0]]), 10)
    for search in (v.exact_search, v.permutation_search):
        assert lists(search(df, "vec_id", "embedding")) == want
        assert search(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").count() == 0
        assert search(spark.createDataFrame([(1, same, 0)], SCHEMA), "vec_id", "embedding").count() == 0


def test_many_ties_go_to_the_lesser_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(40)], SCHEMA)
    for search in (v.exact_search, v.permutation_search):
        got = lists(search(df, "vec_id", "embedding", 3))
        assert got[0] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)] and got[9] == [(0, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0)]


def test_recall_where_vectors_have_no_clusters(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, a.tolist(), 0) for i, a in enumerate(x)], SCHEMA)
    got, want = lists(v.permutation_search(df, "vec_id", "embedding")), lists(v.exact_search(df, "vec_id", "embedding"))
    assert np.mean([len({a for a, *_ in got[i]} & {a for a, *_ in want[i]}) / 10 for i in want]) > 0.93


def test_groups_of_equal_vectors(spark):
    x = cloud(60, d=6, seed=2)
    rows = [(i, x[i % 60 if i < 60 else i % 3].tolist(), 0) for i in range(260)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float32), 4)
    assert lists(v.exact_search(df, "vec_id", "embedding", 4, 6, 40, 8)) == want
    assert lists(v.permutation_search(df, "vec_id", "embedding", 4)) == want


@pytest.mark.parametrize("norm", [1, 6, 1e4])
def test_exact_search_keeps_groups_of_equal_vectors(norm):
    """Eleven equal vectors are each other's ten partners, however the products that compare them are shaped and rounded."""
    r = np.random.default_rng(12)
    for _ in range(6):
        x = r.normal(size=(200, 64))
        x = np.repeat((norm * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 11, axis=0)
        piv = x[r.choice(len(x), 12, replace=False)].astype(np.float64)
        column = pa.array(x.tolist(), pa.list_(pa.float32()))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), column], names=["id", "v"])
        keyed = pa.Table.from_batches(v._cells(iter([batch]), piv))
        cell, key = np.array(keyed.column("cell")), np.array(keyed.column("key"))
        cells = v.Cells.of(piv, [(c, 0, key[cell == c].min(), key[cell == c].max(), int((cell == c).sum())) for c in np.unique(cell)], 10**9)
        assert cells.sizes.tolist() == [len(x)]
        asks = pa.concat_tables([v._bound(own := keyed.filter(pa.array(cell == c)), own, 10) for c in np.unique(cell)])
        found = v._expand(piv, 10, 61, asks, keyed)
        got = {i: {p["id"] for p in ps if p["distance"] == 0} for i, ps in zip(found.column("id").to_pylist(), found.column("partners").to_pylist(), strict=True)}
        assert got == {i: {j for j in range(i - i % 11, i - i % 11 + 11) if j != i} for i in range(len(x))}

"""Every query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import pytest

import __spark_entry__
from tessellum.plans import catalogue, further  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.ORACLES:
        answer = duck.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in answer.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        assert got == sorted((tuple(plain(r[i]) for i in order) for r in answer.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "content", "source", "language", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

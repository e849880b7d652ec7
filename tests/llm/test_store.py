"""Where intermediate tables go, and that nothing of them is left but the tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessellum.llm import store
from tests.llm.cases import clashing


def session(master, **conf):
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default), set=lambda key, value: conf.update({key.replace(".", "_"): value})))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,3000]"])
def test_a_cluster_has_to_name_its_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_dir(session(master))
    assert store.shared_dir(session(master, spark_checkpoint_dir="hdfs://x/shared/")) == "hdfs://x/shared"


def test_a_local_session_gets_one_folder():
    own = session("local[4]")
    assert store.shared_dir(own) == store.shared_dir(own) and store.shared_dir(own).startswith("file:///")


def test_tables_are_written_once_and_can_be_removed(spark):
    before = spark.conf.get(store.CLEANUP, None)
    df, path = store.stored(spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "seven")
    assert df.count() == 7 and path.startswith(store.shared_dir(spark)) and spark.conf.get(store.CLEANUP, None) == before
    store.removed(spark, path)
    with pytest.raises(Exception, match="(?i)exist|no such file"):
        spark.read.parquet(path).count()


def test_names_that_no_column_has(spark):
    df = clashing(spark.range(1).withColumnsRenamed({"id": "ID"}))
    got = store.unused(df, "gone", "gone", "Free", "id")
    assert got[2] == "Free" and len({x.lower() for x in got}) == 4 and not {x.lower() for x in got} & {c.lower() for c in df.columns}

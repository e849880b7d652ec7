"""Tables that cut lineage, in the folder which all executors share, and names that clash with no column."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 4 << 20
_open: list[list[tuple[SparkSession, str]]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(df: DataFrame) -> DataFrame:
    """df; its session hands texts to Python in batches of no more than BATCH_BYTES, or one text.

    Rows alone say little: ten thousand long texts are gigabytes in a task on both sides.
    The setting is the session's, as Spark has none for a single plan; it is only ever lowered.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it, as in tests, gets a folder that ends with the process.

    On a cluster there is no folder to guess: executors would each write to their own disk.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessellum-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        conf = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there.

    A lost executor costs no more than the tasks that it ran: the table outlives it.
    """
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # nothing reads the write's shuffle files once the table is there; Spark itself waits for the garbage collector
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if _open:
        _open[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def passing() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside are deleted at its end, but those written by the function that it gives."""
    mine: list[tuple[SparkSession, str]] = []
    kept: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        kept.append((df.sparkSession, path))
        return out

    _open.append(mine)
    try:
        yield keep
    finally:
        _open.remove(mine)
        for spark, path in mine:
            if (spark, path) not in kept:
                removed(spark, path)
        if _open:
            _open[-1].extend(kept)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

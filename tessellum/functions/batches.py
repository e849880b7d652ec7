"""Work in Python spread evenly over tasks, and cut into parts that stay small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What a batch may hold when it comes to Python, and what of it becomes Python objects at a time.
BATCH_BYTES, PART_BYTES, PART_ROWS, TASKS_A_CORE = 8 << 20, 1 << 20, 1000, 4


def bounded(df: DataFrame) -> DataFrame:
    """df; its session hands Python batches of no more than BATCH_BYTES, or one row.

    Rows alone say little: ten thousand long texts are gigabytes in a task on both sides.
    The setting is the session's, as Spark has none for a single plan; it is only ever lowered.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df over all cores, by a hash of key, however few files or row groups its rows come from."""
    spark = df.sparkSession
    n = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *key)


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows with PART_BYTES or PART_ROWS at most, or one row."""
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    upto = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PART_BYTES, side="right")) - 1)
        j = min(j, i + PART_ROWS, len(texts))
        yield i, j
        i = j

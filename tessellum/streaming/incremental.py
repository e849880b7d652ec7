"""Keeping an index up to date from a stream of files.

A stream of files(project, file_path, content, size), such as a folder that Spark watches,
is indexed micro-batch by micro-batch; a file that comes again replaces its chunks, and one
whose hash is known costs a join.  A batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellum.engine import Engine
from tessellum.functions import paths


def watched(spark: SparkSession, place: str, project: str) -> DataFrame:
    """Text files that appear below a folder, each once, as a streaming table of files."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").schema("value string").load(place)
    name = F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    rel = F.regexp_replace(F.replace(name, F.lit(place.rstrip("/") + "/"), F.lit("")), "^/+", "")
    rows = stream.select(F.lit(project).alias("project"), rel.alias("file_path"), F.col("value").alias("content"), F.octet_length("value").cast("long").alias("size"))
    return rows.where(paths.is_indexable(F.col("file_path")))


def latest(files: DataFrame) -> DataFrame:
    """One row for each file of a batch: of several the one with the greatest hash, so that a rerun agrees."""
    rank = F.row_number().over(Window.partitionBy("project", "file_path").orderBy(F.desc(F.sha2("content", 256))))
    return files.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def indexing(files: DataFrame, engine: Engine, project: str, checkpoint: str, **how: object) -> StreamingQuery:
    """Starts the query; it ends when all that is there has been read, and is started again for more."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.index_table(latest(batch), project, **how)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

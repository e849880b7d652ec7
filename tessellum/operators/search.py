"""Exact cosine search over a chunk table, and the three renderings of its results.

The query is a literal, so a scan scores its own rows and only k rows of each partition
reach the driver (TakeOrderedAndProject); filters on project and language are ordinary
columns and go down to the Parquet scan.  Vectors of length 0 have distance NaN, which
sorts last and is never below a threshold.  Ties go to the lesser id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.functions import paths, vectors
from tessellum.functions import text as tx

LIMIT, THRESHOLD = 10, 0.0


def query_text(words: Sequence[str]) -> str:
    """The words as one text; nothing but white space is an error."""
    text = " ".join(words)
    if not tx.trim(text):
        raise ValueError("the query is empty")
    return text


def similar(
    chunks: DataFrame,
    query: Sequence[float],
    limit: int = LIMIT,
    threshold: float = THRESHOLD,
    language: str | None = None,
    project: str | None = None,
    vector: str = "embedding",
) -> DataFrame:
    """(id, content, source, language, score) of the nearest chunks, the nearest first.

    chunks has id, content, source, language and the vector, and project where one is
    given.  The threshold works behind the limit, so that fewer than limit rows can come.
    """
    rows = chunks
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if language is not None:
        rows = rows.where(F.col("language") == paths.language_filter(language))
    q = [float(x) for x in query]
    similarity = vectors.cosine(vectors.doubles(F.col(vector)), F.array(*[F.lit(x) for x in q]), math.sqrt(math.fsum(x * x for x in q)))
    nearest = rows.select("id", "content", "source", "language", similarity.alias("score")).where("score is not null")
    nearest = nearest.withColumn("distance", 1 - F.col("score")).orderBy("distance", "id").limit(limit)
    return nearest.where(~(F.col("score") < threshold)).drop("distance")


def as_json(found: DataFrame) -> DataFrame:
    """(file, language, score, content), the score with three digits."""
    return found.select(F.col("source").alias("file"), "language", F.round("score", 3).alias("score"), "content")


def json_text(found: DataFrame) -> str:
    """The same as JSON text; [] when nothing was found."""
    import json

    rows = [r.asDict() for r in as_json(found).collect()]
    return json.dumps(rows, ensure_ascii=False, indent=2) if rows else "[]"


def best_of_files(found: DataFrame) -> DataFrame:
    """(source, best, line): the best score of each file, not below 0, the best file first."""
    top = found.groupBy("source").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("m"))
    best = F.when(F.col("m") > 0, F.col("m")).otherwise(0.0)
    rows = top.select("source", best.alias("best"))
    return rows.withColumn("line", F.concat("source", F.lit("  ("), tx.percent(F.col("best")), F.lit(")"))).orderBy(F.desc("best"), "source")


def snippets(found: DataFrame) -> DataFrame:
    """(id, snippet): a heading, and the content between fences, cut where it is long."""
    head = F.concat(F.lit("\n### "), F.col("source"), F.lit("  ("), tx.percent(F.col("score")), F.lit(")"))
    return found.select(
        "id", F.concat_ws("\n", head, F.concat(F.lit("```"), "language"), tx.snippet(F.col("content")), F.lit("```")).alias("snippet")
    )


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()

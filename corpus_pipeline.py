"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  run() writes each result to the shared folder and reads it
again, so a lost executor never costs more than one stage's tasks.

Defined results of all stages: null and empty texts pass as empty ones; texts of any
length are treated whole; rows that are repeated are treated alike; empty tables give empty ones; further columns
are kept, whatever their names, up to the last stage.  What a stage decides about ties and
repeated ids is said by its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import lines, minhash, mixing, packing, quality
from tessellum.llm.store import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model keeps; it is fitted on the labelled ones, and keeps all if no labels are of both kinds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filtered(docs, quality.trained(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that occurred before in the corpus, by doc_id and line; null texts stay null."""
    return lines.deduplicated(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates; rows without doc_id stay."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of their source has them, at least once; but for sources that hold no token at all."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in the slots of sequences; a document without tokens has no piece, and so no row."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the sketches; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

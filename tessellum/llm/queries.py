"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import chat, lines, lm, minhash, mixing, packing, pii, quality, vectors


FLAT = (0.9999, 8.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVERY = 20  # the query set of the searches: ids that it divides


def _neighbours(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("vec_id"), F.col("partner").alias("neighbour_id"), "rank", "distance")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), with_order=True).select("doc_id", "source", "block", "order_key", "n_tokens")


def mixing_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources nearly alike, so that the small ones are repeated whatever the natural weights."""
    docs = mixing.mixed(_table(spark, sf_dir, "documents"), *FLAT, with_order=True)
    return docs.select("doc_id", "source", "block", "order_key", "n_tokens")


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"), pii.trained(pii.labelled_table(spark)))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.trained(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).where(F.col("score") >= model.threshold).select("doc_id", "score")


def op5_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of whole documents under a model that was trained on all of them."""
    docs = _table(spark, sf_dir, "documents")
    v = lm.vocabulary(docs)
    return lm.scored(docs, lm.trained(docs, v), v)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op8_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(vectors.permutation_search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=EVERY))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(_table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_dropped")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(vectors.exact_search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=EVERY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_temperature_mixing": op1_temperature_mixing,
    "op2_pii_crf": op2_pii_crf,
    "op3_chat_format": op3_chat_format,
    "op4_quality_gam": op4_quality_gam,
    "op5_minhash_groups": op5_minhash_groups,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_permutation_ann": op8_permutation_ann,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_exact_topk": op10_exact_topk,
    "mixing_flattened": mixing_flattened,
}

ORACLES: dict[str, str] = {
    "op1_temperature_mixing": mixing.SQL,
    "mixing_flattened": mixing.sql(*FLAT),
    "op10_exact_topk": vectors.sql(EVERY),
}

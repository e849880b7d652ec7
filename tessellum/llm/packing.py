"""Best-fit packing planned on the histogram of lengths.

A document of n tokens (runs of non-blank characters) gives n // capacity pieces that
fill a bin and one with the rest.  Best-fit decreasing runs over the histogram, not the
documents: a plan step puts `count` pieces of one length into bins that have the same
space left, several to a bin where they fit.  The plan is bounded by the capacity, not
by the corpus.  Pieces then take the planned slots by joining on their rank within
their length; the rank is a bucket's offset plus a running count within (length, wave,
bucket), so no length is sorted in one task.

Rows alike in doc_id and length are copies.  They are counted before anything is
ranked, and the k-th copy goes to wave k, which has bins of its own: no sequence holds
two copies of a piece.  From WAVES copies on, waves take a copy more each, and these go
to the bins of a step in turn.

Defined results: null texts and texts without tokens have no piece and no row; texts of
any length are cut into pieces whole; rows that repeat a doc_id get slots of their own, in
waves of their own; null doc_ids are kept; no documents: no rows.  Other columns are not
looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.mixing import BROADCAST_BYTES, n_tokens
from tessellum.llm.store import written

CAPACITY, WAVES = 2048, 16
BUCKET_ROWS = 1 << 18  # that are ranked in one task
PLAN = "wave int, length int, rank_from long, rank_to long, bin_from long, n_bins long, offset int"


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, end rank, first bin, bins, offset in the bins).

    Pieces of a step go to its bins in turn.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    spaces: list[int] = []  # in order; bins with one space are ranges of bin numbers
    ranges: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in ranges:
                insort(spaces, space)
            ranges.setdefault(space, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space], spaces[at]
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            per = space // length
            whole = min(n, left // per)
            used = 0
            if whole:
                steps.append((length, rank, rank + whole * per, first, whole, capacity - space))
                leave(space - per * length, first, whole)
                rank, left, used = rank + whole * per, left - whole * per, whole
            if left and used < n:  # fewer than a bin takes
                steps.append((length, rank, rank + left, first + used, 1, capacity - space))
                leave(space - left * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            leave(space, first + used, n - used)
    return steps


def packed(docs: DataFrame, capacity: int = CAPACITY, waves: int = WAVES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, bin_offset) of every piece of every document."""
    spark = docs.sparkSession
    copies = docs.select("doc_id", n_tokens(F.col("text")).alias("n")).where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    pieces = copies.select("doc_id", "n", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / capacity).cast("long") - 1)).alias("piece"))
    pieces = pieces.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"),
        "copies",
        F.explode(F.sequence(F.lit(0), F.least(F.col("copies"), F.lit(waves)).cast("int") - 1)).alias("wave"),
    )
    pieces = pieces.withColumn("copies", F.expr(f"(copies - wave - 1) div {waves} + 1"))
    pieces = written(pieces, "pieces")
    buckets = max(1, -(-pieces.count() // bucket_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    key = ["wave", "length"]
    counts = written(pieces.groupBy(*key, "bucket").agg(F.sum("copies").alias("n")), "counts")
    # rows: waves x capacity at most
    histograms: dict[int, dict[int, int]] = {}
    for r in counts.groupBy(*key).agg(F.sum("n").alias("n")).collect():
        histograms.setdefault(r["wave"], {})[r["length"]] = r["n"]
    rows, bins = [], 0
    for wave in sorted(histograms):
        steps = plan(histograms[wave], capacity)
        rows += [(wave, length, a, b, bins + first, n, offset) for length, a, b, first, n, offset in steps]
        bins += max(first + n for *_, first, n, _ in steps)
    steps = spark.createDataFrame(rows, PLAN)
    if 64 * len(rows) <= BROADCAST_BYTES:
        steps = F.broadcast(steps)  # a length may have most of the pieces: they needn't meet in one task
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy(*key, "bucket").orderBy("doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        pieces.withColumn("upto", F.sum("copies").over(upto))
        .join(offsets, [*key, "bucket"])
        .withColumn("first", F.col("before") + F.col("upto") - F.col("copies"))
        .select(*key, "doc_id", "piece", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("rank"))
    )
    i = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(steps, key)
        .where("rank >= rank_from and rank < rank_to")
        .select(
            "doc_id",
            "piece",
            (F.col("piece").cast("long") * capacity).alias("first_token"),
            F.col("length").alias("n_tokens"),
            (F.col("bin_from") + F.pmod(i, F.col("n_bins"))).alias("bin_id"),
            (F.col("offset") + F.floor(i / F.col("n_bins")) * F.col("length")).cast("int").alias("bin_offset"),
        )
    )

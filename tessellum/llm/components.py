"""Connected groups of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.store import removed, stored


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of its group, for each node of edges(a, b).

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which
    converge in a logarithmic number of rounds; every round is two shuffles of the
    edges and is written to the shared folder.  Loops, repeated edges and edges with
    a null are ignored.  No edges: no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    spark = edges.sparkSession
    e, path = stored(e.distinct(), "edges")
    for _ in range(most_rounds):
        # large star: neighbours above u go to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least.hint("shuffle_hash"), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small star: u and its lesser neighbours go to the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m.hint("shuffle_hash"), "u").select("u", "v", "m")
        new = (
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new, place = stored(new, "edges")
        # done when every node hangs on one root and no root hangs on another
        ends = new.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(new.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        left = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        removed(spark, path)  # the round that follows it is written
        e, path = new, place
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"the groups did not settle in {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

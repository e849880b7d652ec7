"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

The tokens (runs of non-blank characters) n_i of each source give weights proportional
to n_i ** a.  The exponent a in [0, 1] is found by bisection: the greatest at which the
weights' entropy is at least `entropy` of the largest possible (1, the natural weights,
if they have that), raised as far as it takes to repeat no source more than
`max_epochs` times.  An exponent of 1 gives every document once.

Without a `budget` the mixture has as many tokens as it takes for every source to be
there whole: sources are repeated, none is cut short of a pass.  Budgets of sources
are whole tokens by largest remainders, so they add up to the budget of the mixture.  A source's
budget is spent on blocks: whole passes over the source, each in its own pseudo-random
order, then a last block that ends with the document in which the budget ends, if half
of that document or more is within it.

That place is found without sorting a source in one task: sums over buckets of the order
key, then an exact look into the one bucket where the budget ends.

Defined results: a null source is the source ''; null and empty texts have no tokens, and
go with the block that they fall in; a text counts whole, however long; sources without
tokens get no block; rows alike in doc_id share an order key and are taken or left
together; null doc_ids order as ''; an empty table gives an empty one; all columns are
kept, whatever their names.  A budget that no exponent can spend within max_epochs is an
error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.store import unused, written

ENTROPY, MAX_EPOCHS, SEED, STEPS = 0.95, 4.0, 17, 50
BROADCAST_BYTES = 8 << 20  # of the plan, a row for each source


@dataclass(frozen=True)
class Share:
    source: str
    tokens: int
    weight: float
    budget: int

    @property
    def full(self) -> int:
        return self.budget // self.tokens

    @property
    def rest(self) -> int:
        return self.budget % self.tokens


def _weights(tokens: list[int], a: float) -> list[float]:
    z = math.fsum(n**a for n in tokens)
    return [n**a / z for n in tokens]


def _size(tokens: list[int], weights: list[float], budget: int | None) -> float:
    return budget if budget is not None else max(n / w for n, w in zip(tokens, weights, strict=True))


def exponent(tokens: list[int], entropy: float, max_epochs: float, budget: int | None = None) -> float:
    """The exponent for the targets, by bisection of [0, 1]."""

    def even(a: float) -> bool:
        w = _weights(tokens, a)
        return -math.fsum(x * math.log(x) for x in w) >= entropy * math.log(len(tokens)) - 1e-12

    def seldom(a: float) -> bool:
        w = _weights(tokens, a)
        size = _size(tokens, w, budget)
        return max(x * size / n for n, x in zip(tokens, w, strict=True)) <= max_epochs * (1 + 1e-12)

    if not seldom(1.0):
        raise ValueError(f"a budget of {budget} tokens repeats {sum(tokens)} of them more than {max_epochs} times")
    low, high = 0.0, 1.0
    if even(1.0):
        return 1.0
    for _ in range(STEPS):
        a = (low + high) / 2
        low, high = (a, high) if even(a) else (low, a)
    if seldom(low):
        return low
    high = 1.0
    for _ in range(STEPS):
        a = (low + high) / 2
        low, high = (low, a) if seldom(a) else (a, high)
    return high


def shares(tokens: dict[str, int], entropy: float, max_epochs: float, budget: int | None) -> list[Share]:
    tokens = {s: n for s, n in sorted(tokens.items()) if n}
    if not tokens:
        return []
    counts = list(tokens.values())
    w = _weights(counts, exponent(counts, entropy, max_epochs, budget))
    total = math.ceil(_size(counts, w, budget) * (1 - 1e-12))
    own = [math.floor(total * x) for x in w]
    # a token more to the largest remainders, so that no token of the budget is lost to rounding
    for i in sorted(range(len(w)), key=lambda i: (own[i] - total * w[i], i))[: total - sum(own)]:
        own[i] += 1
    if budget is None:
        own = [max(n, b) for n, b in zip(counts, own, strict=True)]
    return [Share(s, n, x, b) for (s, n), x, b in zip(tokens.items(), w, own, strict=True)]


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def order_key(seed: int, block: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _plan(narrow: DataFrame, entropy: float, max_epochs: float, budget: int | None, seed: int) -> DataFrame:
    """One row for each source: whole blocks, and the last order key of the cut one."""
    spark = narrow.sparkSession
    counts = {r["s"]: r["n"] for r in narrow.groupBy("s").agg(F.sum("t").alias("n")).collect()}
    rows = [(x.source, x.full, x.rest) for x in shares(counts, entropy, max_epochs, budget)]
    plan = spark.createDataFrame(rows, "s string, full long, rest long")
    keyed = narrow.join(plan.where("rest > 0"), "s").select("s", "t", "rest", order_key(seed, F.col("full"), F.col("doc_id")).alias("k"))
    keyed = keyed.withColumn("bucket", F.substring("k", 1, 3))
    sums = keyed.groupBy("s", "rest", "bucket").agg(F.sum("t").alias("t"))
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sums.withColumn("upto", F.sum("t").over(upto))
        .where("upto > rest")
        .groupBy("s")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("cut"))
        .select("s", F.col("cut.bucket").alias("bucket"), F.col("cut.before").alias("before"))
    )
    within = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        keyed.join(cut, ["s", "bucket"])
        .groupBy("s", "k", "rest", "before")
        .agg(F.sum("t").alias("t"))
        .withColumn("upto", F.col("before") + F.sum("t").over(within))
        .where("upto <= rest or (upto - t < rest and 2 * (rest - upto + t) >= t)")
        .groupBy("s")
        .agg(F.max("k").alias("last"))
    )
    # a cut that falls on no key takes all keys of the buckets before it; without a rest no key is taken
    return plan.join(cut, "s", "left").join(last, "s", "left").select("s", "full", F.coalesce("last", "bucket", F.lit("")).alias("last"))


def mixed(
    docs: DataFrame,
    entropy: float = ENTROPY,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    seed: int = SEED,
    with_order: bool = False,
) -> DataFrame:
    """docs with each row as often as the mixture has it; all columns as they are.

    with_order adds block, order_key (which sorts a block of a source) and n_tokens.
    What is collected is a row for each source.
    """
    narrow = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"), F.col("doc_id"), n_tokens(F.col("text")).alias("t")
    )
    narrow = written(narrow, "tokens")
    rows = _plan(narrow, entropy, max_epochs, budget, seed).collect()
    s, full, last, number = unused(docs, "s", "full", "last", "block")
    plan = docs.sparkSession.createDataFrame([tuple(r) for r in rows], f"`{s}` string, `{full}` long, `{last}` string")
    if sum(len(r["s"].encode()) + 64 for r in rows) <= BROADCAST_BYTES:
        plan = F.broadcast(plan)  # the join then moves the plan, not the texts; beyond that size both are shuffled
    joined = docs.join(plan, F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col(s))
    in_last = (order_key(seed, F.col(full), docs["doc_id"]) <= F.col(last)).cast("int")
    times = F.col(full).cast("int") + F.coalesce(in_last, F.lit(0))
    cols = [docs[f"`{c}`"] for c in docs.columns]
    out = joined.where(times > 0).select(*cols, F.explode(F.sequence(F.lit(0), times - 1)).alias(number))
    extra = []
    if with_order:
        extra = [
            F.col(number).alias("block"),
            order_key(seed, F.col(number), docs["doc_id"]).alias("order_key"),
            n_tokens(docs["text"]).alias("n_tokens"),
        ]
    return out.select(*cols, *extra)


def sql(entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same rows from DuckDB.

    It searches for the exponent by other means: entropy and repetitions are tabulated over
    exponents that get closer together around the place where they cross their bounds.
    """
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS t FROM documents
), n AS (
  SELECT source, sum(t)::DOUBLE AS n FROM d GROUP BY 1 HAVING sum(t) > 0
), zoom(step, a, width) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, max(x) FILTER (WHERE ok), any_value(width) / 32
  FROM (
    SELECT step, width, x, x = a OR (x <= 1 AND
      (SELECT -sum(w * ln(w)) FROM (SELECT pow(n, x) / sum(pow(n, x)) OVER () AS w FROM n)) >= {entropy} * (SELECT ln(count(*)) FROM n) - 1e-12) AS ok
    FROM (SELECT *, a + width * unnest(range(33)) / 32 AS x FROM zoom WHERE step < 11)
  ) GROUP BY step
), rarer AS (
  SELECT greatest(max(a), 1 - ln({max_epochs}) / nullif((SELECT ln(max(n)) - ln(min(n)) FROM n), 0), 0) AS a FROM zoom WHERE step = 11
), w AS (
  SELECT source, n, pow(n, a) / sum(pow(n, a)) OVER () AS w FROM n, rarer
), f AS (
  SELECT source, n, total, floor(total * w) AS base, total * w - floor(total * w) AS part
  FROM (SELECT *, ceil(max(n / w) OVER () * (1 - 1e-12)) AS total FROM w)
), p AS (
  SELECT source, n, greatest(n, base + CASE WHEN row_number() OVER (ORDER BY part DESC, source) <= total - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS budget FROM f
), k AS (
  SELECT d.*, budget // n::BIGINT AS whole, budget % n::BIGINT AS rest, md5(concat('{seed}:', budget // n::BIGINT, ':', coalesce(d.doc_id::VARCHAR, ''))) AS k
  FROM d JOIN p USING (source)
), u AS (
  SELECT source, k, t, rest, sum(t) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, k, rest, sum(t) AS t FROM k GROUP BY ALL)
), times AS (
  SELECT k.doc_id, k.source, k.t,
    k.whole + CASE WHEN k.rest > 0 AND (u.upto <= u.rest OR (u.upto - u.t < u.rest AND 2 * (u.rest - u.upto + u.t) >= u.t)) THEN 1 ELSE 0 END AS times
  FROM k JOIN u USING (source, k)
), r AS (
  SELECT doc_id, source, t, unnest(range(times)) AS block FROM times
)
SELECT doc_id, source, block::INTEGER AS block, md5(concat('{seed}:', block, ':', coalesce(doc_id::VARCHAR, ''))) AS order_key, t AS n_tokens
FROM r
"""


SQL = sql()

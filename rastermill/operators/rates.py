"""Budgets against cumulative costs, and palettes by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.functions.constants import U32, XORSHIFT_SEED


def rate_curve(costs: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """costs (keys, ordinal, cost), costs not below 0, and budgets (keys, budget) -> (keys, budget, n): how many costs, in order,
    each budget pays for; an as-of join in one pass.

    The sums of costs are sorted together with the budgets of the same keys, and each budget takes the number of the last sum
    before it."""
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = costs.select(*keys, F.sum("cost").over(w).cast("double").alias("at"), F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")).alias("n"), F.lit(None).cast("double").alias("budget"))
    asked = budgets.select(*keys, F.col("budget").cast("double").alias("at"), F.lit(None).cast("int").alias("n"), F.col("budget").cast("double").alias("budget"))
    merged = Window.partitionBy(*keys).orderBy("at", F.col("budget").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.unionByName(asked).withColumn("n", F.coalesce(F.max("n").over(merged), F.lit(0)).cast("long")).where("budget IS NOT NULL").select(*keys, "budget", "n")


# Squared distance of a patch to the nearest centre, and which that is.
NEAR = "array_min(transform(centres, (q, i) -> struct((p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b) AS d2, i AS i)))"
# The first patch at which the running sum of weights reaches a share of their whole.
DRAWN = """element_at(patches, least(size(patches), 1 + aggregate(weights, struct(0D AS sum, 0 AS n, false AS met),
 (a, w) -> CASE WHEN a.met THEN a WHEN a.sum + w >= target THEN struct(a.sum + w AS sum, a.n AS n, true AS met) ELSE struct(a.sum + w AS sum, a.n + 1 AS n, false AS met) END, a -> a.n)))"""
TARGET = "aggregate(weights, 0D, (a, w) -> a + w) * (shiftright(random, 9) / 8388608D)"
COLOR = f"transform(array({DRAWN}), p -> struct(p.r AS r, p.g AS g, p.b AS b))"


def palette_seeds(patches: DataFrame, keys: list[str], size: int) -> DataFrame:
    """patches (keys, seq, r, g, b, c, and sums wr, wg, wb; doubles), a few hundred a key -> (keys, patches, centres): the first
    `size` centres, each drawn by the fixed generator in proportion to weight and squared distance from those before.

    A recursion: each step adds a centre to all palettes at once, from nothing but the row's own list of patches."""
    listed = F.array_sort(F.collect_list(F.struct("seq", *(F.col(x).cast("double").alias(x) for x in ("r", "g", "b", "c", "wr", "wg", "wb")))))
    rows = patches.groupBy(*keys).agg(listed.alias("patches"))
    named = ", ".join(keys)
    step = f"""SELECT {named}, patches, random, centres, weights, {TARGET} AS target"""
    return rows.sparkSession.sql(
        f"""WITH RECURSIVE seeds({named}, patches, random, centres) AS (
 SELECT {named}, patches, {XORSHIFT_SEED}L, {COLOR} FROM (SELECT *, {TARGET} AS target FROM (SELECT *, {XORSHIFT_SEED}L AS random, transform(patches, p -> p.c) AS weights FROM {{rows}}))
 UNION ALL
 SELECT {named}, patches, random, concat(centres, {COLOR}) FROM ({step} FROM (SELECT {named}, patches, centres, (b ^ b * 32) & {U32}L AS random, transform(patches, p -> {NEAR}.d2 * p.c) AS weights
  FROM (SELECT *, a ^ shiftright(a, 17) AS b FROM (SELECT *, (random ^ random * 8192) & {U32}L AS a FROM seeds WHERE size(centres) < {size})))))
SELECT {named}, patches, centres FROM seeds WHERE size(centres) = {size}""",
        rows=rows,
    )


def palette_rounds(seeds: DataFrame, keys: list[str], rounds: int = 90) -> DataFrame:
    """seeds of palette_seeds() -> (keys, round, error, centres): Lloyd steps until one betters the weighted squared error by less
    than 1. A palette that takes more than `rounds` is an error."""
    named = ", ".join(keys)
    moved = """transform(centres, (q, i) -> transform(array(aggregate(near, struct(0D AS r, 0D AS g, 0D AS b, 0D AS c),
 (a, n) -> CASE WHEN n.i = i THEN struct(a.r + n.wr AS r, a.g + n.wg AS g, a.b + n.wb AS b, a.c + n.c AS c) ELSE a END)), s -> struct(s.r / greatest(s.c, 1D) AS r, s.g / greatest(s.c, 1D) AS g, s.b / greatest(s.c, 1D) AS b))[0])"""
    near = f"transform(patches, p -> transform(array({NEAR}), m -> struct(m.d2 AS d2, m.i AS i, p.c AS c, p.wr AS wr, p.wg AS wg, p.wb AS wb))[0])"
    found = seeds.sparkSession.sql(
        f"""WITH RECURSIVE steps({named}, patches, centres, round, error, gain) AS (
 SELECT {named}, patches, centres, 0, 1e35D, 1e35D FROM {{seeds}}
 UNION ALL
 SELECT {named}, patches, {moved}, round + 1, now, error - now
 FROM (SELECT *, aggregate(near, 0D, (a, n) -> a + n.d2 * n.c) AS now FROM (SELECT *, {near} AS near FROM steps WHERE gain >= 1 AND round <= {rounds})))
SELECT {named}, round, error, centres, gain FROM steps WHERE gain < 1 OR round > {rounds}""",
        seeds=seeds,
    )
    late = F.raise_error(F.concat(F.lit(f"a palette takes more than {rounds} rounds")))
    return found.select(*keys, "round", "error", F.when(F.col("gain") < 1, F.col("centres")).otherwise(late.cast(found.schema["centres"].dataType)).alias("centres"))

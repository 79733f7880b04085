"""Regions as spans (y, x0, x1), and how lines cut them.

Region tables are keyed by any columns; `keys` names them. Angle tables have sn and cs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.functions import columns as C
from rastermill.functions import constants as K


def root_spans(images: DataFrame) -> DataFrame:
    """A span over the whole row for each row of an image (width, height)."""
    y = F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y")
    return images.select(*images.columns, y, F.lit(0).cast("long").alias("x0"), F.col("width").alias("x1"))


def region_stats(spans: DataFrame, prefix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sr, sg, sb, c): channel sums and pixel count of each region, from its spans' two ends."""
    sums = ("sr", "sg", "sb", "c")
    low = prefix.select("image_id", "y", F.col("x").alias("x0"), *(F.col(s).alias(f"low_{s}") for s in sums))
    high = prefix.select("image_id", "y", F.col("x").alias("x1"), *(F.col(s).alias(f"high_{s}") for s in sums))
    joined = spans.join(low, ["image_id", "y", "x0"]).join(high, ["image_id", "y", "x1"])
    return joined.groupBy(*keys).agg(*(F.sum(F.col(f"high_{s}") - F.col(f"low_{s}")).alias(s) for s in sums))


def squared_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size): squared diagonal of each region's bounds."""
    dx, dy = F.max("x1") - F.min("x0"), F.max("y") + 1 - F.min("y")
    return spans.groupBy(*keys).agg((dx * dx + dy * dy).alias("size"))


def distance_range(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """cuts: spans with sn, cs and line_limit. (keys, low, high, line_quant, num_lines): how far a
    region reaches across an angle's lines, and the lines that are tried there."""
    at = F.col("cs") * F.col("y") + F.col("sn") * F.col("x0")
    reach = cuts.groupBy(*keys).agg(F.min(at).alias("low"), F.max(F.col("cs") * F.col("y") + F.col("sn") * (F.col("x1") - 1)).alias("high"), F.first("line_limit").alias("line_limit"))
    delta, limit = F.col("high") - F.col("low"), F.col("line_limit").cast("long")
    quant = F.when(delta > K.SCALE * limit, C.div(2 * delta + limit, 2 * limit)).otherwise(C.long(K.SCALE))
    reach = reach.withColumn("line_quant", quant).withColumn("num_lines", F.greatest(C.long(1), C.div(delta, F.col("line_quant"))))
    return reach.drop("line_limit")


def line_distance(line: Column) -> Column:
    """The offset of a line, from the columns of distance_range; the sum of a single line's ends is
    taken modulo 2**32."""
    low, high, n, quant = (F.col(c) for c in ("low", "high", "num_lines", "line_quant"))
    several = low + C.div(high - low - (n - 1) * quant, 2) + quant * line
    return F.when(n > 1, several).otherwise(C.div(F.pmod(high + low, F.lit(1 << 32)), 2))


def boundary(exact: bool = True) -> Column:
    """Where the line of offset d cuts row y, within the span; from columns y, x0, x1, sn, cs, d.

    Pixels from there on are the left side. The exact rule decides the pieces; the other
    one, in single precision, is what candidates are scored by, and may differ by a pixel.
    """
    single = lambda x: x.cast("float").cast("double")
    y, x0, x1, sn, cs, d = (F.col(c) for c in ("y", "x0", "x1", "sn", "cs", "d"))
    if exact:
        level, cut = y * cs >= d, C.div(2 * d + sn - 2 * y * cs, 2 * sn)
    else:
        level = y >= (single(d) / single(cs)).cast("float")
        cut = (y.cast("double") * single(-cs / sn) + single(d * (1.0 / sn) + 0.5)).cast("float").cast("long")
    return F.when(sn == 0, F.when(level, x0).otherwise(x1)).otherwise(F.least(x1, F.greatest(x0, cut)))


def split_spans(cuts: DataFrame) -> DataFrame:
    """cuts: spans with sn, cs and d -> their non-empty parts, `side` L or R."""
    at = boundary()
    parts = F.array(F.struct(F.lit("L").alias("side"), at.alias("x0"), F.col("x1").alias("x1")), F.struct(F.lit("R").alias("side"), F.col("x0").alias("x0"), at.alias("x1")))
    others = [c for c in cuts.columns if c not in ("x0", "x1")]
    return cuts.select(*others, F.explode(parts).alias("part")).select(*others, "part.side", "part.x0", "part.x1").where(F.col("x0") < F.col("x1"))


def paint(leaves: DataFrame) -> DataFrame:
    """leaves: spans with r, g, b -> pixels."""
    x = F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")
    return leaves.where(F.col("x1") > F.col("x0")).select("image_id", "y", x, "r", "g", "b")

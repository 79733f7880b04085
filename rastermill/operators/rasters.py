"""Rasters as pixels, their prefix sums, and images derived from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.functions import columns as C
from rastermill.functions import constants as K

CHANNELS = ("r", "g", "b")


def from_embeddings(embeddings: DataFrame, rows: int = 16) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) of images made of `rows` vectors each, in the order of their ids; an image
    that misses some is less high."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("vec_id")) - 1
    placed = embeddings.where(F.col("embedding").isNotNull()).withColumn("image_id", C.div(F.col("vec_id"), rows)).withColumn("y", place.cast("long"))
    cells = placed.select("image_id", "y", F.posexplode("embedding").alias("x", "e"))
    pixels = cells.select("image_id", "y", F.col("x").cast("long").alias("x"), F.floor((F.col("e").cast("double") + 1) * 127.5).alias("r"))
    return pixels.select("image_id", "y", "x", "r", (255 - F.col("r")).alias("g"), ((F.col("r") * 7 + F.col("x") * 3) % 256).alias("b"))


def from_lineitem(lineitem: DataFrame, side: int = 32) -> DataFrame:
    """Pixels of one image for each line number, cells without a row are 0."""
    cells = lineitem.groupBy(F.col("l_linenumber").cast("long").alias("image_id"), (F.col("l_orderkey") % side).alias("y"), (F.col("l_partkey") % side).alias("x")).agg(
        (F.sum(F.col("l_quantity").cast("long")) % 256).alias("r"), (F.count(F.lit(1)) * 16 % 256).alias("g"), (F.sum("l_suppkey") % 256).alias("b")
    )
    numbers = lineitem.select(F.col("l_linenumber").cast("long").alias("image_id")).where("image_id IS NOT NULL").distinct()
    each = numbers.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side * side - 1).cast("long"))).alias("id"))
    grid = each.select("image_id", C.div(F.col("id"), side).alias("y"), (F.col("id") % side).alias("x"))
    return grid.join(cells, ["image_id", "y", "x"], "left").na.fill(0, list(CHANNELS))


def cross(spark: SparkSession, image_id: int = 0) -> DataFrame:
    """A white cross on red, 20 by 20."""
    cell = spark.range(400).select(F.lit(image_id).cast("long").alias("image_id"), C.div(F.col("id"), 20).alias("y"), (F.col("id") % 20).alias("x"))
    bit = F.getbit(F.lit(0x23880).cast("long"), (F.shiftright("x", 2) + 5 * F.shiftright("y", 2)).cast("int")).cast("long")
    return cell.select("image_id", "y", "x", F.lit(255).cast("long").alias("r"), (bit * 255).alias("g"), (bit * 255).alias("b"))


def from_rgba(df: DataFrame) -> DataFrame:
    """(image_id, width, data binary of interleaved RGBA) -> pixels; alpha is dropped."""
    pixel = F.explode(F.sequence(F.lit(0).cast("long"), C.div(F.octet_length("data"), 4).cast("long") - 1)).alias("i")
    rows = df.where(F.octet_length("data") >= 4).select("image_id", "width", "data", pixel)
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), (F.col("i") * 4 + k + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return rows.select("image_id", C.div(F.col("i"), F.col("width")).alias("y"), (F.col("i") % F.col("width")).alias("x"), byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height)."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def guarded(images: DataFrame) -> DataFrame:
    """Adds `reason`: why an image (width, height) can't be coded, or null."""
    bad = ~F.col("width").between(K.LEAST_SIDE, K.LARGEST_SIDE) | ~F.col("height").between(K.LEAST_SIDE, K.LARGEST_SIDE)
    return images.withColumn("reason", F.when(bad, F.lit("size")))


def prefix_sums(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, sr, sg, sb, c): sums over the pixels of row y left of x, for x from 0 to the width."""
    w = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = pixels.select("image_id", "y", (F.col("x") + 1).alias("x"), *(F.sum(c).over(w).alias(f"s{c}") for c in CHANNELS), (F.col("x") + 1).alias("c"))
    zero = pixels.where(F.col("x") == 0).select("image_id", "y", *(F.lit(0).cast("long").alias(n) for n in ("x", "sr", "sg", "sb", "c")))
    return sums.unionByName(zero)


def square_sums(pixels: DataFrame) -> DataFrame:
    """(image_id, sqe_base): the sum of all squared channel values."""
    return pixels.groupBy("image_id").agg(F.sum(F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b")).alias("sqe_base"))

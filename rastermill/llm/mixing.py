"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sources stand side by side on a line, each as wide as its number of slots; the van der Corput
sequence visits that line's cells, which gives slots their order in the mix. A source's
documents are shuffled and cut into blocks of equal tokens; its r-th slot takes block r,
beginning again after the last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.llm.common import Scratch, running_start

BLOCK_TOKENS = 1_000_000
LEAST_BLOCKS = 1_000
ROWS_A_WINDOW = 20_000
SLOTS_A_ROW = 10_000
ROW, ORIGIN, COPIES = "_rastermill_row", "_rastermill_origin", "_rastermill_copies"
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes: (source, source_size). Adds ord, weight and target.

    Ordered by the weight at which a source is full, the sources up to some point get `cap`
    times their size and all later ones share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("ord", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * cap
    by_ratio = Window.orderBy(full / F.col("weight"), "ord")
    rows = ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum(full).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("fits", full / F.col("weight") >= F.col("level")).withColumn("share", F.min(F.when(F.col("fits"), F.struct(full / F.col("weight"), F.col("ord"), F.col("level").alias("level")))).over(Window.partitionBy())["level"])
    return rows.withColumn("target", F.least(full.cast("double"), F.col("share") * F.col("weight"))).select("source", "source_size", "ord", "weight", "target")


def with_blocks(sources: DataFrame) -> DataFrame:
    """Adds block (tokens in a block), blocks, slots and the cell where the source's slots begin."""
    block = F.greatest(F.lit(1), F.floor(F.least(F.lit(float(BLOCK_TOKENS)), F.col("target") / LEAST_BLOCKS)))
    rows = sources.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    rows = rows.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    return rows.withColumn("cell", F.coalesce(F.sum("slots").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(ord, at, rank, block_no): for each slot its place in the mix (`at` ascending), its source
    and the block it takes."""
    bits = max(1, (max(slots, 1) - 1).bit_length())
    # A large source's slots are made in stretches, so that no task makes all of them.
    begins = F.explode(F.sequence(F.col("cell"), F.col("cell") + F.col("slots") - 1, F.lit(SLOTS_A_ROW).cast("long"))).alias("begin")
    stretches = sources.where("slots > 0").select("ord", "blocks", (F.col("cell") + F.col("slots") - 1).alias("last"), begins)
    if slots > SLOTS_A_ROW:
        stretches = stretches.repartition("begin")
    cells = stretches.select("ord", "blocks", F.explode(F.sequence(F.col("begin"), F.least(F.col("last"), F.col("begin") + SLOTS_A_ROW - 1))).alias("cell"))
    points = cells.withColumn("at", F.conv(F.reverse(F.lpad(F.bin("cell"), bits, "0")), 2, 10).cast("long"))
    points = points.withColumn("spread", F.col("at") / float(1 << bits)).withColumn("one", F.lit(1).cast("long"))
    ranked = running_start(points, ["ord"], "spread", ["at"], "one", "rank", math.ceil(slots / ROWS_A_WINDOW))
    return ranked.select("ord", "at", "rank", F.pmod("rank", "blocks").alias("block_no"))


def mix(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, digest, source, size, source_size, target, taken), a row for each of `df`.

    `size` counts words (null text: 0). Sources in order of code points, null last, weigh
    `weights`, repeating, and share all words; a target stops at `cap` times its source. `taken`
    counts the words of the document that the mix takes, repeats included, `cap` times its
    size at most. Empty documents take nothing; texts of any length count whole. Rows that are equal
    share what their copies take in an undefined order. Sources that tie stand in the order of their
    names. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select("doc_id", "source", row_digest().alias("digest"), text_size(F.col("text")).alias("size"))
    docs = scratch.write(docs, "sized")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sources = scratch.write(with_blocks(targets(sizes.select("source", "source_size"), weights, cap)), "sources")
    totals = sources.agg(F.sum("slots").alias("slots")).first()
    count = docs.count()
    times = schedule(sources, totals["slots"] or 0).groupBy("ord", "block_no").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("times"))
    known = docs.join(sources.select(F.col("source").alias("_source"), "source_size", "ord", "target", "block"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    known = known.withColumn("spread", F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") / float(1 << 48))
    placed = running_start(known.where("size > 0"), ["ord"], "spread", ["digest"], "size", "start", math.ceil(count / ROWS_A_WINDOW))
    pieces = placed.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    row = ["doc_id", "digest", "source", "size", "source_size", "target"]
    taken = pieces.join(times, ["ord", "block_no"], "left").groupBy(*row, "ord", "start").agg(F.sum(inside * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    return taken.select(*row, "taken").unionByName(known.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken")))


def row_digest() -> Column:
    """Of a row's id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def repeat_documents(df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """`df` with each row as often as the mix takes its words, rounded to whole documents; rows of one id and text in
    two sources each as often as their own source says.

    Null and empty texts, and others without words, go. Equal rows share what their copies take; null
    doc_ids and sources are kept like others. All columns of `df` stay as they are, whatever their
    names; an empty table gives an empty table.
    """
    mixed = mix(df, weights, cap).where("size > 0").groupBy(F.col("digest").alias(ROW), F.col("source").alias(ORIGIN))
    mixed = mixed.agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(COPIES)).where(F.col(COPIES) > 0)
    joined = df.join(mixed, (row_digest() == F.col(ROW)) & df["source"].eqNullSafe(F.col(ORIGIN)))
    return joined.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(*df.columns)

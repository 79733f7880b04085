"""Coding images: trees for all variants, simulated colours, the best of them, and its stream."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rastermill.functions import columns as C
from rastermill.functions import constants as K
from rastermill.operators import entropy as E
from rastermill.operators import palette as P
from rastermill.operators import rasters as R
from rastermill.operators.deal import dealt
from rastermill.operators.splits import prefix_rows
from rastermill.operators.tree import KEYS, TREE, budget_prefix, build_trees, coding_jobs, drop_folder, scratch, stored

TRIAL = [*TREE, "color"]


def color_trials(jobs: DataFrame, nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """(trial, quant, palette, n): for each allowed colour code how many splits fit; two at least."""
    colors = jobs.withColumn("color", F.explode(C.bits_set(F.col("color_options"), K.COLOR_CODES)))
    colors = colors.withColumn("quant", C.color_quant(F.col("color"))).withColumn("palette", C.palette_size(F.col("color")))
    node_tax = 1 + F.when(F.col("palette") == 0, 3 * F.log2("quant")).otherwise(F.log2("palette"))
    colors = colors.withColumn("node_tax", node_tax).withColumn("budget", 8 * F.col("target_size") - 4 - F.col("tax") - 24 * F.col("palette") - F.col("node_tax"))
    costs = taken.join(nodes.select(*KEYS, "cost"), KEYS).join(colors, TREE)
    fits = budget_prefix(costs.select(*TRIAL, "ordinal", (F.col("cost") + F.col("node_tax")).alias("cost"), "budget"), TRIAL)
    return colors.select(*TRIAL, "quant", "palette").join(fits.where("n > 1"), TRIAL)


def gather_patches(trials: DataFrame, nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """The leaves of each trial's tree, in the order of their parents: means r, g, b, size c, sums wr, wg, wb."""
    most = trials.groupBy(*TREE).agg(F.max("n").alias("_most"))
    order = taken.join(most, TREE).where("ordinal < _most").select(*TREE, "node", "ordinal")  # later splits are in no trial
    child = F.explode(F.array(F.struct(F.concat("parent", F.lit("L")).alias("node"), F.lit(0).alias("side")), F.struct(F.concat("parent", F.lit("R")).alias("node"), F.lit(1).alias("side")))).alias("child")
    children = order.select(*TREE, F.col("node").alias("parent"), F.col("ordinal").alias("above")).select(*TREE, "above", child).select(*TREE, "above", "child.*")
    children = children.join(order, KEYS, "left").join(nodes.select(*KEYS, "sr", "sg", "sb", "c"), KEYS)
    leaves = trials.join(children, TREE).where((F.col("above") < F.col("n")) & (F.col("ordinal").isNull() | (F.col("ordinal") >= F.col("n"))))
    means = [(F.col(f"s{x}") / F.col("c")).alias(x) for x in ("r", "g", "b")]
    return leaves.select(*TRIAL, "quant", "palette", "node", (2 * F.col("above") + F.col("side")).alias("seq"), *means, F.col("c").cast("double").alias("c"), *(F.col(f"s{x}").cast("double").alias(f"w{x}") for x in ("r", "g", "b")))


def simulated_error(shown: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sqe): squared error less the constant part; shown has means r, g, b, size c and the colours
    vr, vg, vb that are shown instead."""
    part = sum((F.col("c") * F.col(f"v{x}") * (F.col(f"v{x}") - 2 * F.col(x)) for x in ("r", "g", "b")), F.lit(0.0))
    return shown.groupBy(*keys).agg(F.sum(part).alias("sqe"))


def shown_colors(patches: DataFrame, palettes: DataFrame) -> DataFrame:
    """Adds to each patch what the simulation shows for it, in single precision: vr, vg, vb, and idx for palettes."""
    single = lambda x: F.lit(x).cast("float")
    most = F.col("quant").cast("float") - single(1)
    value = lambda x: F.floor((F.col(x).cast("float") * (most / single(255)) + single(0.5)).cast("int").cast("float") * (single(255) / F.greatest(most, single(1))))
    plain = patches.where("palette = 0").select("*", *(value(x).cast("double").alias(f"v{x}") for x in ("r", "g", "b")), F.lit(None).cast("int").alias("idx"))
    near = P.nearest(patches.where("palette > 0").select(*TRIAL, "node", "r", "g", "b"), palettes, TRIAL, ["node"])
    named = near.join(palettes, [*TRIAL, "idx"]).select(*TRIAL, "node", "idx", *(F.col(f"p{x}").alias(f"v{x}") for x in ("r", "g", "b")))
    return plain.unionByName(patches.where("palette > 0").join(named, [*TRIAL, "node"]).select(plain.columns))


def first_best(errors: DataFrame) -> DataFrame:
    """The least error of each image; of equals the first variant, then the first colour code."""
    best = F.min(F.struct("sqe", "variant_id", "color"))
    return errors.groupBy("image_id").agg(best.alias("best")).select("image_id", "best.variant_id", "best.color", "best.sqe")


def stream_entries(jobs: DataFrame, best: DataFrame, nodes: DataFrame, taken: DataFrame, trials: DataFrame, shown: DataFrame, palettes: DataFrame) -> DataFrame:
    """(image_id, entries): header, palette, then nodes level by level, from left to right."""
    chosen = best.select("image_id", "variant_id", "color").join(jobs, TREE)
    header = chosen.select(*TRIAL, E.header_entries(F.col("width"), F.col("height"), F.col("partition_code"), F.col("line_limit"), F.col("color")).alias("items"), F.lit(-2).alias("depth"), F.lit("").alias("node"))
    colors = palettes.join(best.select(*TRIAL), TRIAL)
    colors = colors.select(*TRIAL, E.entries(*(E.entry(F.col(f"p{x}"), F.lit(256)) for x in ("r", "g", "b"))).alias("items"), F.lit(-1).alias("depth"), F.lpad(F.col("idx").cast("string"), 2, "0").alias("node"))
    inner = trials.join(best.select(*TRIAL), TRIAL).join(taken, TREE).where("ordinal < n").join(nodes, KEYS)
    angles = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("angle_bits").cast("int"))
    inner = inner.select(*TRIAL, E.entries(E.entry(F.lit(1), F.lit(2)), E.entry(F.col("angle_code"), angles), E.entry(F.col("line"), F.col("num_lines"))).alias("items"), F.length("node").alias("depth"), "node")
    leaf = shown.join(best.select(*TRIAL), TRIAL)
    plain = E.entries(E.entry(F.lit(0), F.lit(2)), *(E.entry(C.quantize(F.col(x), F.col("quant")), F.col("quant")) for x in ("r", "g", "b")))
    leaf = leaf.select(*TRIAL, F.when(F.col("palette") == 0, plain).otherwise(E.entries(E.entry(F.lit(0), F.lit(2)), E.entry(F.col("idx"), F.col("palette")))).alias("items"), F.length("node").alias("depth"), "node")
    parts = dealt(header.unionByName(colors).unionByName(inner).unionByName(leaf), "image_id")
    ordered = F.array_sort(F.collect_list(F.struct("depth", "node", "items")))
    return parts.groupBy("image_id").agg(F.flatten(F.transform(ordered, lambda p: p["items"])).alias("entries"))


class Search:
    """The variants of one table of images, tried in rounds; what is given up is counted."""

    def __init__(self, images: DataFrame, pixels: DataFrame, target_size: int):
        self.images, self.target_size = images, target_size
        self.at = scratch(pixels.sparkSession)
        self.rows = stored(prefix_rows(R.prefix_sums(pixels)), f"{self.at}/rows")
        self.round = 0

    def trials(self, jobs: DataFrame) -> tuple[DataFrame, ...]:
        """(jobs, nodes, taken, trials, palettes, shown) of some jobs, stored."""
        at = f"{self.at}/{self.round}"
        self.round += 1
        jobs = stored(jobs, f"{at}/jobs")
        nodes = build_trees(jobs, self.rows, f"{at}/nodes")
        taken = nodes.where("ordinal IS NOT NULL").select(*KEYS, "ordinal")
        alive = jobs.drop("color_options").join(nodes.where("node = ''").select(*TREE, F.col("options").alias("color_options")), TREE)
        trials = stored(color_trials(alive, nodes, taken), f"{at}/trials")
        patches = stored(gather_patches(trials, nodes, taken), f"{at}/patches")
        palettes = stored(P.build_palettes(patches.where("palette > 0"), TRIAL), f"{at}/palettes")
        return jobs, nodes, taken, trials, palettes, stored(shown_colors(patches, palettes), f"{at}/shown")

    def best(self, variants: DataFrame, first_round: int, growth: int) -> tuple[DataFrame, tuple[DataFrame, ...] | None]:
        """(image_id, variant_id, color, sqe) of the first best trial, and all trials where they fit one round. Later rounds grow by
        `growth` and know the least error of those before, which ends the trees and colour codes that can't reach it."""
        turned = stored(variants.withColumn("_turn", F.row_number().over(Window.orderBy(F.xxhash64("variant_id"), "variant_id"))), f"{self.at}/variants")
        count, begin, size, best, parts = turned.count(), 0, first_round, None, None
        while begin < count:
            jobs = coding_jobs(self.images, turned.where(F.col("_turn").between(begin + 1, begin + size)).drop("_turn"), self.target_size)
            if best is not None:
                jobs = jobs.drop("bound").join(best.select("image_id", F.col("sqe").alias("bound")), "image_id", "left")
            parts = self.trials(jobs)
            found = first_best(simulated_error(parts[-1], TRIAL))
            best = stored(found if best is None else first_best(found.unionByName(best)), f"{self.at}/best-{self.round}")
            begin, size = begin + size, size * growth
        return best, parts if self.round == 1 else None

    def drop(self) -> None:
        drop_folder(self.rows.sparkSession, self.at)


def encode_images(pixels: DataFrame, variants: DataFrame, target_size: int = 200, first_round: int = 64, growth: int = 8) -> DataFrame:
    """(image_id, status, variant_id, color, mse, data): a row for each image of `pixels`.

    `variants` (variant_id, partition_code, line_limit as an index, color_options) are all tried, in rounds of
    `first_round`, then `growth` times as many; what can't reach the best error of earlier rounds is given up, which changes no
    result. A variant_id that repeats is refused. `status` is ok, size (a side out of bounds) or flat (no variant
    splits it twice); only the first has a stream, of `target_size` bytes or fewer.
    """
    if not variants.groupBy("variant_id").count().where("count > 1").isEmpty():
        raise ValueError("variant_id repeats")
    images = R.guarded(R.sizes(pixels))
    good = images.where("reason IS NULL")
    search = Search(good, pixels.join(good, "image_id", "left_semi"), target_size)
    best, parts = search.best(variants, first_round, growth)
    if parts is None:  # the winners of several rounds once more
        winner = best.select("image_id", "variant_id", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("color")).alias("color_options"))
        parts = search.trials(coding_jobs(good, variants, target_size).drop("color_options").join(winner, TREE))
    mse = (F.col("sqe") + F.col("sqe_base")) / (F.col("width") * F.col("height"))
    streams = stream_entries(parts[0], best, *parts[1:4], shown=parts[5], palettes=parts[4]).select("image_id", E.encode_stream("entries").alias("data"))
    coded = best.join(streams, "image_id").join(R.square_sums(pixels), "image_id")
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("data").isNull(), "flat").otherwise("ok")
    found = stored(images.join(coded, "image_id", "left").select("image_id", status.alias("status"), "variant_id", "color", mse.alias("mse"), "data"), f"{scratch(pixels.sparkSession)}/coded")
    search.drop()
    return found


@F.pandas_udf(T.BinaryType())
def result_record(mse: pd.Series, data: pd.Series) -> pd.Series:
    """A coded image as one record: the stream's size and the error, 32 bits each, little-endian, then the stream;
    null without a stream."""
    return pd.Series([None if d is None else struct.pack("<If", len(d), m) + bytes(d) for m, d in zip(mse, data, strict=True)])

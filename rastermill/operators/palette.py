"""Palettes: nearest colours, and centres chosen from a partition's patches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions.constants import U32, XORSHIFT_SEED
from rastermill.operators.deal import dealt


def nearest(patches: DataFrame, palette: DataFrame, keys: list[str], patch: list[str]) -> DataFrame:
    """patches (keys, patch, r, g, b) and palette (keys, idx, pr, pg, pb; 32 rows a key at most) ->
    (keys, patch, idx, d2): the nearest colour, of equals the first. A palette is one array, so patches meet it
    by their key and are chosen for row by row, without a grouping of their own."""
    colours = palette.groupBy(*keys).agg(F.collect_list(F.struct("idx", "pr", "pg", "pb")).alias("_colours"))

    def away(p):
        d2 = sum(((F.col(c) - p[f"p{c}"]) * (F.col(c) - p[f"p{c}"]) for c in ("r", "g", "b")), F.lit(0.0))
        return F.struct(d2.alias("d2"), p["idx"].alias("idx"))

    best = F.array_min(F.transform("_colours", away)).alias("best")
    return patches.join(colours, keys).select(*keys, *patch, best).select(*keys, *patch, "best.idx", "best.d2")


def accumulate(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """assigned (keys, idx, wr, wg, wb, c) -> the new centres (keys, idx, pr, pg, pb, c)."""
    sums = assigned.groupBy(*keys, "idx").agg(*(F.sum(x).alias(x) for x in ("wr", "wg", "wb", "c")))
    return sums.select(*keys, "idx", *((F.col(f"w{x}") / F.greatest(F.col("c"), F.lit(1))).alias(f"p{x}") for x in ("r", "g", "b")), "c")


def choose_centres(colors: np.ndarray, weights: np.ndarray, sums: np.ndarray, size: int) -> np.ndarray:
    """k-means with weighted seeding by a fixed generator; a patch is a row. Ends when a step improves
    the weighted squared error by less than 1; centres are rounded."""
    state = XORSHIFT_SEED

    def draw(chances: np.ndarray) -> int:
        partial = np.cumsum(chances, dtype=np.float32)
        at = int(np.searchsorted(partial, np.float32(partial[-1] * np.float32((state >> 9) / 8388608.0))))
        return min(at, len(chances) - 1)

    def distances(centres: np.ndarray) -> np.ndarray:
        return ((colors[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)

    centres = colors[[draw(weights)]]
    near = distances(centres)[:, 0]
    while len(centres) < size:
        state ^= state << 13 & U32
        state ^= state >> 17
        state ^= state << 5 & U32
        centres = np.vstack([centres, colors[draw(near * weights)]])
        near = np.minimum(near, distances(centres[-1:])[:, 0])
    last = np.inf
    while True:
        d2 = distances(centres)
        nearest_ = d2.argmin(axis=1)
        error = float((d2.min(axis=1) * weights).sum())
        total = np.zeros((size, 4), np.float32)
        np.add.at(total, nearest_, np.column_stack([sums, weights]).astype(np.float32))
        centres = total[:, :3] / np.maximum(total[:, 3:], 1)
        if last - error < 1:
            return np.floor(centres + 0.5)
        last = error


def build_palettes(patches: DataFrame, keys: list[str]) -> DataFrame:
    """patches (keys, palette, seq, r, g, b, c, wr, wg, wb), a few hundred a key -> (keys, idx, pr, pg, pb). All patches of a key
    are a row, and a task takes many."""
    types = dict(patches.dtypes)
    values = ("r", "g", "b", "c", "wr", "wg", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("patches")
            ends, rows = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]), lists.flatten()
            r, g, b, c, *sums = (rows.field(v).to_numpy(zero_copy_only=False).astype(np.float32) for v in values)
            colors, sums = np.column_stack([r, g, b]), np.column_stack(sums)
            sizes = batch.column("palette").to_numpy(zero_copy_only=False).astype(int)
            found = [choose_centres(colors[i:k], c[i:k], sums[i:k], int(size)) for i, k, size in zip(ends, ends[1:], sizes, strict=False)]
            of = pa.array(np.repeat(np.arange(len(batch)), sizes))
            idx = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), pa.array(idx), *(pa.array(x.astype(np.float64)) for x in np.concatenate(found).T)], names=[*keys, "idx", "pr", "pg", "pb"])

    listed = F.array_sort(F.collect_list(F.struct("seq", *values)))
    rows = dealt(patches, *keys).groupBy(*keys).agg(F.first("palette").alias("palette"), listed.alias("patches"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", idx int, pr double, pg double, pb double"
    return rows.mapInArrow(run, schema)

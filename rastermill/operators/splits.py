"""The best line to split each region by.

All candidates of a region, up to 512 angles by 63 lines, are scored where the region and its image's prefix
sums meet, by arrays within a task (best_splits), or as rows from a count of the region's pixels by lines (line_sums)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.window import Window

from rastermill.functions import columns as C
from rastermill.functions import constants as K
from rastermill.functions.dimensions import COS, SIN, angles
from rastermill.operators import geometry as G
from rastermill.operators.deal import dealt, in_lots, tasks

SUMS = ("sr", "sg", "sb", "c")
BEST = ("score", "angle_code", "line", "sn", "cs", "d", "num_lines")
PART_SPANS, KNOWN_REGIONS, CANDIDATES = 50_000, 2_000, 1 << 16
LOT_SPANS, LOT_REGIONS = 2_000, 8


def split_score() -> Column:
    """How far the means of both sides (l_* sums against whole sums) are from the common mean, by size."""
    total = F.lit(0.0)
    right_c = F.col("c") - F.col("l_c")
    for s in ("sr", "sg", "sb"):
        mean = F.col(s) / F.col("c")
        left = F.col(f"l_{s}") / F.col("l_c") - mean
        right = (F.col(s) - F.col(f"l_{s}")) / right_c - mean
        total = total + left * left * F.col("l_c") + right * right * right_c
    return total


def candidates(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans: with angle_bits and line_limit -> (keys, angle_code, line, sn, cs, d, num_lines):
    every line tried for each region. A region has at most 512 angles."""
    spark = spans.sparkSession
    code = F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("angle_bits").cast("int")) - 1)).alias("angle_code")
    turned = spans.select(*keys, "y", "x0", "x1", "line_limit", "angle_bits", code)
    turned = turned.withColumn("angle", F.call_function("shiftleft", F.col("angle_code"), F.lit(9) - F.col("angle_bits").cast("int")))
    turned = turned.join(F.broadcast(angles(spark).select("angle", "sn", "cs")), "angle")  # 512 rows
    reach = G.distance_range(turned, [*keys, "angle_code", "sn", "cs"])
    lines = reach.withColumn("line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_lines") - 1)))
    return lines.select(*keys, "angle_code", "line", "sn", "cs", G.line_distance(F.col("line")).alias("d"), "num_lines")


def reached_line(exact: bool) -> Column:
    """The last line that has the pixel (x, y) on its left side, -1 for none; all lines before it have it there too.
    From columns x, y, sn, cs and first (the offset of line 0), line_quant, num_lines."""
    x, y, sn, cs = (F.col(c) for c in ("x", "y", "sn", "cs"))
    most = F.when(sn == 0, y * cs).otherwise(F.floor((sn * (2 * x + 1) + 2 * y * cs - 1) / 2))
    line = F.floor((most - F.col("first")) / F.col("line_quant"))
    if not exact:
        single = lambda c: c.cast("float").cast("double")

        def left(at: Column) -> Column:
            d = F.col("first") + F.col("line_quant") * at
            cut = (y.cast("double") * single(-cs / sn) + single(d * (1.0 / sn) + 0.5)).cast("float")
            return F.when(sn == 0, y >= (single(d) / single(cs)).cast("float")).otherwise(cut < x + 1)

        # Rounding moves a boundary by far less than the distance of two lines.
        line = F.when(left(line + 1), line + 1).when(left(line), line).otherwise(line - 1)
    return F.least(F.col("num_lines") - 1, F.greatest(C.long(-1), line))


def line_sums(spans: DataFrame, pixels: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """(keys, angle_code, line, sn, cs, d, num_lines, l_* sums of the left side, sums of the whole): every candidate
    line of each region that has pixels on both sides, from one pass over the region's pixels for each angle.

    spans have angle_bits and line_limit; images have all their pixels. Lines of an angle are parallel, so a pixel lies
    to the left of a line and of all before it, or of none: pixels are counted by the last such line, and sums that
    run over the lines give what is to the left of each. Counting is done before rows are dealt out; what a group of the
    running sums holds is a row a line, at most.
    """
    spark = spans.sparkSession
    code = F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("angle_bits").cast("int")) - 1)).alias("angle_code")
    turned = spans.select(*keys, "y", "x0", "x1", "line_limit", "angle_bits", code)
    turned = turned.withColumn("angle", F.call_function("shiftleft", F.col("angle_code"), F.lit(9) - F.col("angle_bits").cast("int")))
    turned = turned.join(F.broadcast(angles(spark).select("angle", "sn", "cs")), "angle")  # 512 rows
    reach = G.distance_range(turned, [*keys, "angle_code", "sn", "cs"])
    line = ["sn", "cs", "first", "line_quant", "num_lines"]
    reach = reach.withColumn("first", G.line_distance(C.long(0)))
    known = reach.groupBy(*keys).agg(F.collect_list(F.struct("angle_code", *line)).alias("angles"))  # 512 a region, at most
    cells = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))).alias("cells"))
    rows = spans.select(*keys, "y", "x0", "x1").join(cells, ["image_id", "y"]).join(known, keys)
    inside = F.slice("cells", (F.col("x0") + 1).cast("int"), (F.col("x1") - F.col("x0")).cast("int"))
    rows = rows.select(*keys, "y", inside.alias("cells"), F.explode("angles").alias("at")).select(*keys, "y", "at.*", F.explode("cells").alias("cell"))
    met = rows.select(*keys, "angle_code", "y", *line, "cell.*").withColumn("bin", reached_line(exact))
    counted = met.groupBy(*keys, "angle_code", "bin").agg(*(F.sum(c).alias(f"s{c}") for c in ("r", "g", "b")), F.count(F.lit(1)).alias("c"), *(F.max(c).alias(c) for c in line))
    group = Window.partitionBy(*keys, "angle_code")
    down = group.orderBy(F.col("bin").desc())
    before = F.coalesce(F.lead("bin").over(down), C.long(-1))
    sums = counted.select(*keys, "angle_code", "bin", *line, before.alias("before"), *(F.sum(s).over(group).alias(s) for s in SUMS), *(F.sum(s).over(down).alias(f"l_{s}") for s in SUMS))
    # Lines that end no pixel's stretch have what the next one that does has.
    lines = sums.where((F.col("bin") >= 0) & (F.col("l_c") < F.col("c"))).withColumn("line", F.explode(F.sequence(F.col("before") + 1, F.col("bin"))))
    return lines.select(*keys, "angle_code", "line", "sn", "cs", (F.col("first") + F.col("line_quant") * F.col("line")).alias("d"), "num_lines", *SUMS, *(f"l_{s}" for s in SUMS))


def prefix_rows(prefix: DataFrame) -> DataFrame:
    """Prefix sums as a row for each row of an image: (image_id, y, sr, sg, sb), lists by x."""
    cell = F.struct("x", "sr", "sg", "sb")
    rows = prefix.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("image_id", "y", *(F.col(f"cells.{s}").alias(s) for s in SUMS[:3]))


class ImageScorer:
    """Scores all candidate lines of an image's regions from its prefix sums."""

    def __init__(self, rows: pd.DataFrame, exact: bool):
        self.exact, self.known = exact, {}
        rows = rows.sort_values("y")
        self.sums = [np.array(rows[s].tolist(), np.int64) for s in SUMS[:3]]
        self.first = int(rows["y"].iloc[0]) if len(rows) else 0
        squares = sum(np.diff(p, axis=1) ** 2 for p in self.sums)
        self.square_sums = np.pad(np.cumsum(squares, axis=1), ((0, 0), (1, 0)))
        # Sums, and pixels, that fit one number of 64 bits for any region are added up as one: (prefix sums, [(channel, lowest bit, mask)]).
        self.packs, room = [], 0
        planes = [*self.sums, np.broadcast_to(np.arange(self.sums[0].shape[1]), self.sums[0].shape)]
        for k, plane in enumerate(planes):
            bits = int(plane[:, -1].sum()).bit_length()
            if bits > room:
                self.packs.append((np.zeros_like(plane), []))
                room = 64
            packed, parts = self.packs[-1]
            packed += plane << 64 - room
            parts.append((k, 64 - room, (1 << bits) - 1))
            room -= bits

    def squares(self, spans: np.ndarray) -> int:
        """The sum of all squared channel values of a region."""
        y = spans[:, 0] - self.first
        return int((self.square_sums[y, spans[:, 2]] - self.square_sums[y, spans[:, 1]]).sum())

    def best(self, spans: np.ndarray, bits: int, limit: int) -> tuple:
        """Of a region (rows y, x0, x1): its sums, and score, angle code, line, sn, cs, d, number of lines of the
        best candidate (None where no line scores 0.5). Regions that return with the same bits and limit, as
        roots do for most variants, are scored once."""
        key = (spans.tobytes(), bits, limit)
        if key not in self.known:
            if len(self.known) >= KNOWN_REGIONS:
                self.known.clear()
            self.known[key] = self.search(spans, bits, limit)
        return self.known[key]

    def search(self, spans: np.ndarray, bits: int, limit: int) -> tuple:
        whole, turns = self.tried(spans, bits, limit)
        best: tuple = (0.5, None)
        for code, line, sn, cs, d, lines, _, total in turns:
            if len(total):
                n = int(total.argmax())
                score = float(total[n])
                if score > best[0] or best[1] is None and score >= 0.5:
                    best = (score, tuple(int(v[n]) for v in (code, line, sn, cs, d, lines)))
        return (*whole, best[0], *best[1]) if best[1] else (*whole, *[None] * 7)

    def tried(self, spans: np.ndarray, bits: int, limit: int) -> tuple[list[int], Iterator[tuple]]:
        """The sums of a region, and all lines that leave pixels on both sides, by angle, then line: arrays of code, line, sn, cs, d,
        number of lines, left pixels and score, some angles at a time."""
        y, x0, x1 = spans.T
        at, each = y - self.first, np.arange(len(y))
        packs = [(p[at] - p[at, x0][:, None], parts) for p, parts in self.packs]
        whole = [0] * 4
        for packed, parts in packs:
            sums = int(packed[each, x1].sum())
            for k, shift, mask in parts:
                whole[k] = sums >> shift & mask
        codes, sn, cs = turned(bits)
        near = cs[:, None] * y
        low, high = (near + sn[:, None] * x0).min(axis=1), (near + sn[:, None] * (x1 - 1)).max(axis=1)
        delta = high - low
        quant = np.where(delta > K.SCALE * limit, (2 * delta + limit) // (2 * limit), K.SCALE)
        lines = np.maximum(1, delta // quant)
        slack = delta - (lines - 1) * quant
        first = np.where(lines > 1, low + np.sign(slack) * (np.abs(slack) // 2), (high + low) % (1 << 32) // 2)
        return whole, self.turns(y, x0, x1, whole, packs, codes, sn, cs, first, quant, lines)

    def turns(self, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, whole: list[int], packs: list, codes: np.ndarray, sn: np.ndarray, cs: np.ndarray, first: np.ndarray, quant: np.ndarray, lines: np.ndarray) -> Iterator[tuple]:
        ends, begin = np.cumsum(lines), 0
        before = ends - lines
        rows, left, right = (v[:, None] for v in (y, x0, x1))
        starts = (np.arange(len(y)) * packs[0][0].shape[1])[:, None]
        means = np.array([s / whole[3] for s in whole[:3]])[:, None]
        while begin < len(codes):
            end = max(begin + 1, int(np.searchsorted(ends, before[begin] + CANDIDATES // len(y), side="right")))
            of = np.repeat(np.arange(begin, end), lines[begin:end])
            line = np.arange(before[begin], ends[end - 1]) - before[of]
            s, c = sn[of], cs[of]
            d = first[of] + quant[of] * line
            flat = edges(rows, left, right, s, c, d, self.exact) + starts
            sides = np.empty((4, len(of)), np.int64)
            for packed, parts in packs:
                sums = packed.ravel()[flat].sum(axis=0)
                for k, shift, mask in parts:
                    sides[k] = whole[k] - (sums >> shift & mask)
            valid = np.flatnonzero((sides[3] > 0) & (sides[3] < whole[3]))
            sides = sides[:, valid]
            part, count = sides[:3], sides[3]
            other = whole[3] - count
            near, far = part / count - means, (np.array(whole[:3])[:, None] - part) / other - means
            near, far = near * near * count, far * far * other
            total = near[0] + far[0] + near[1] + far[1] + near[2] + far[2]
            of = of[valid]
            yield codes[of], line[valid], s[valid], c[valid], d[valid], lines[of], count, total
            begin = end


@cache
def turned(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The angles of `bits` bits: codes, sn, cs."""
    codes = np.arange(1 << bits)
    return codes, SIN[codes << 9 - bits], COS[codes << 9 - bits]


def edges(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, sn: np.ndarray, cs: np.ndarray, d: np.ndarray, exact: bool) -> np.ndarray:
    """geometry.boundary() for arrays; lines by sn, cs and d, or also rows against lines."""
    flat = sn == 0
    level = None
    if flat.any():
        level = y * cs >= d if exact else y >= d.astype(np.float32) / np.where(flat, cs, 1).astype(np.float32)
        if flat.all():
            return np.where(level, x0, x1)
    some = np.where(flat, 1, sn)
    if exact:
        top = 2 * d + sn - 2 * y * cs
        cut = np.sign(top) * (np.abs(top) // (2 * some))
    else:
        slope, shift = (-cs / some).astype(np.float32), (d * (1.0 / some) + 0.5).astype(np.float32)
        cut = (y.astype(np.float64) * slope + shift).astype(np.float32).astype(np.int64)
    cut = np.minimum(x1, np.maximum(x0, cut))
    return cut if level is None else np.where(flat, np.where(level, x0, x1), cut)


def best_splits(spans: DataFrame, prefix: DataFrame, keys: list[str], exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """spans: with angle_bits and line_limit. The sums of each region, and its best candidate: the
    largest score, of equals the first angle, then the first line. Regions without a candidate
    of score 0.5 or more have none."""
    both = scored_regions(spans, prefix_rows(prefix), keys, exact)
    return both.select(*keys, *SUMS), both.where("score IS NOT NULL").drop(*SUMS)


def scored_regions(spans: DataFrame, rows: DataFrame, keys: list[str], exact: bool = False, lots: bool = False) -> DataFrame:
    """(keys, sums, score, angle_code, line, sn, cs, d, num_lines): best_splits() in one table, from the result of
    prefix_rows(). An image's regions are dealt into parts of about PART_SPANS spans, each of which gets
    the image's rows; candidates never leave the task. With `lots` small images share a group of about LOT_SPANS spans, for
    which spans are counted first."""
    types = dict(spans.dtypes)
    names = [*keys, *SUMS, *BEST]

    def run(regions: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        out = [(*key, *scorer.best(each, bits, limit)) for key, scorer, each, bits, limit in met_regions(regions, image, keys, exact)]
        found = pd.DataFrame(out, columns=names)
        return found.astype({n: "Int64" for n in (*SUMS, *BEST[1:])} | {"score": "Float64"})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", sr long, sg long, sb long, c long, score double, angle_code int, line long, sn long, cs long, d long, num_lines long"
    own = [c for c in keys if c != "image_id"]
    region = F.xxhash64(*own) if own else F.lit(0).cast("long")
    parts = spans.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / PART_SPANS).alias("_parts"))
    given = spans.join(parts, "image_id").withColumn("_part", F.pmod(region, "_parts")).select(*keys, "y", "x0", "x1", "angle_bits", "line_limit", "_part")
    if lots:
        return in_groups(given, rows, LOT_SPANS, [*own, "y", "x0"]).applyInPandas(run, schema)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_piece")
    copies = rows.join(parts, "image_id").select(F.col("image_id").alias("_image"), "y", *SUMS[:3], piece)
    return given.groupBy("image_id", "_part").cogroup(copies.groupBy("_image", "_piece")).applyInPandas(run, schema)


def in_groups(given: DataFrame, rows: DataFrame, most: int, counted: list[str]) -> PandasCogroupedOps:
    """Regions with their `_part` beside their images' rows, a group for each lot of `most` of what `counted` tells apart
    (see in_lots)."""
    at = ["image_id", "_part"]
    work = given.groupBy(*at).agg((F.count_distinct(*counted) if counted else F.lit(1)).alias("_work"))
    lots = in_lots(work, at, most, tasks(given.sparkSession))
    copies = rows.join(lots, "image_id").select(F.col("image_id").alias("_image"), F.col("_part").alias("_piece"), F.col("_lot").alias("_group"), "y", *SUMS[:3])
    return dealt(given.join(lots, at), "_lot").groupBy("_lot").cogroup(dealt(copies, "_group").groupBy("_group"))


def met_regions(regions: pd.DataFrame, image: pd.DataFrame, keys: list[str], exact: bool) -> Iterator[tuple]:
    """(key, scorer, spans, angle bits, line limit) of each region of a group."""
    if not len(regions):
        return
    images = dict(iter(image.groupby(["_image", "_piece"], sort=False)))
    for at, some in regions.groupby(["image_id", "_part"], sort=False):
        scorer = ImageScorer(images.pop(at), exact)
        for key, each in some.groupby(keys, sort=False):
            each = each.sort_values(["y", "x0"])
            yield key, scorer, each[["y", "x0", "x1"]].to_numpy(np.int64), int(each["angle_bits"].iloc[0]), int(each["line_limit"].iloc[0])


def line_scores(spans: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, angle_code, line, d, num_lines, l_c, score): every candidate line of each region that has pixels on both sides, as
    line_sums() has them, by the rule of single precision. From the result of prefix_rows(): all lines of a region are scored by arrays,
    and only these are rows. A group has about LOT_REGIONS regions, of 512 angles by their lines each."""
    types = dict(spans.dtypes)

    def run(regions: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"angle_code": np.zeros(0, np.int32)})]
        for key, scorer, each, bits, limit in met_regions(regions, image, keys, False):
            for code, line, _, _, d, lines, count, score in scorer.tried(each, bits, limit)[1]:
                found.append(pd.DataFrame({"angle_code": code, "line": line, "d": d, "num_lines": lines, "l_c": count, "score": score}).assign(**dict(zip(keys, key, strict=True))))
        return pd.concat(found, ignore_index=True).reindex(columns=names)

    names = [*keys, "angle_code", "line", "d", "num_lines", "l_c", "score"]
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", angle_code int, line long, d long, num_lines long, l_c long, score double"
    own = [c for c in keys if c != "image_id"]
    region = F.xxhash64(*own) if own else F.lit(0).cast("long")
    parts = spans.groupBy("image_id").agg(F.ceil((F.count_distinct(*own) if own else F.lit(1)) / LOT_REGIONS).alias("_parts"))
    given = spans.join(parts, "image_id").withColumn("_part", F.pmod(region, "_parts")).select(*keys, "y", "x0", "x1", "angle_bits", "line_limit", "_part")
    return in_groups(given, rows, LOT_REGIONS, own).applyInPandas(run, schema)

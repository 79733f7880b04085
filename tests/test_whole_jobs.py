"""Queries that do the whole job and have no SQL, against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import constants as K
from rastermill.operators import decode as D
from rastermill.operators import entropy as E
from rastermill.operators import rasters as R
from rastermill.operators.entropy import Reader
from rastermill.plans import queries as Q

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def brute_pixels(read):
    """A stream's pixels {(y, x): colour}, region by region and pixel by pixel, and its header; no
    pixels if a region is empty."""
    number = read.number

    def side():
        bits = number(8) + 3
        return (1 << bits) + number(1 << bits) + 1

    width, height = side(), side()
    f1, f2, f3, f4 = number(4), number(5), number(5), number(5)
    limit, color = number(63) + 1, number(49)
    palette = [tuple(number(256) for _ in range(3)) for _ in range(max(0, color - 16))]
    steps = 1 + ((4 + color % 4) << (color // 4))
    scales, scale = [], (width * width + height * height) * (f2 + 2) ** 2 % 2**32
    for _ in range(7):
        scales.append(scale // 36)
        scale = scale * 40 % 2**32 // (1000, 630, 398, 251, 158)[f3]
    queue, out, splits = [[(y, x) for y in range(height) for x in range(width)]], {}, 0
    for region in queue:
        if not region:
            return None, None
        if number(2) == 0:
            shade = palette[number(len(palette))] if palette else tuple(255 * number(steps) // (steps - 1) for _ in range(3))
            out |= dict.fromkeys(region, shade)
            continue
        splits += 1
        ys, xs = zip(*region, strict=True)
        size = (max(xs) + 1 - min(xs)) ** 2 + (max(ys) + 1 - min(ys)) ** 2
        level = next((i for i, s in enumerate(scales) if size >= s), 6)
        bits = max(0, 9 - f1 - level - level * f4 // 2)
        angle = number(1 << bits) << (9 - bits)
        sn, cs = int(D.SIN[angle]), int(D.COS[angle])
        reach = [cs * y + sn * x for y, x in region]
        low, high = min(reach), max(reach)
        quant = (2 * (high - low) + limit) // (2 * limit) if high - low > K.SCALE * limit else K.SCALE
        n = max(1, (high - low) // quant)
        line = number(n)
        d = low + (high - low - (n - 1) * quant) // 2 + quant * line if n > 1 else (high + low) % 2**32 // 2
        left = [y * cs >= d if sn == 0 else x >= (2 * d + sn - 2 * y * cs) // (2 * sn) for y, x in region]
        queue += [[p for p, at in zip(region, left, strict=True) if at], [p for p, at in zip(region, left, strict=True) if not at]]
    return out, {"width": width, "height": height, "code": f1 + 4 * (f2 + 5 * (f3 + 5 * f4)), "limit": limit, "color": color, "splits": splits}


class Writer:
    """Stands in for a reader: makes numbers up (the first ones are given) and keeps them with their bounds."""

    def __init__(self, seed, first):
        self.random, self.first, self.pairs = random.Random(seed), list(first), []

    def number(self, bound):
        value = self.first.pop(0) if self.first else self.random.randrange(bound)
        if bound == 2:
            value = int(self.random.random() < (0.9 if len(self.pairs) < 60 else 0.2))
        self.pairs.append((value, bound))
        return value


def made_stream(seed, width, height, code, limit, color):
    """A stream of an arbitrary tree; empty regions end it, so only seeds without one are used."""
    parts = [code % 4, code // 4 % 5, code // 20 % 5, code // 100]
    write = Writer(seed, [1, width - 17, 1, height - 17, *parts, limit - 1, color])
    pixels, head = brute_pixels(write)
    return pixels and (E.encode(*map(list, zip(*write.pairs, strict=True))), pixels, head)


def made_streams():
    cases = [(32, 30, 215, 7, 4), (31, 17, 7, 20, 9), (20, 20, 499, 63, 22), (18, 32, 0, 3, 16), (20, 31, 120, 12, 48)]
    found = []
    for case in cases:
        found += [next(s for seed in range(1000) if (s := made_stream(seed + 7 * len(found), *case)) and s[2]["splits"] >= 5)]
    return found


def test_all_streams_are_decoded(spark, monkeypatch):
    made = made_streams()
    assert max(h["splits"] for _, _, h in made) >= 10 and {h["color"] for _, _, h in made} == {4, 9, 22, 16, 48}
    rows = spark.createDataFrame([(i, bytearray(data)) for i, (data, _, _) in enumerate(made)], "image_id long, data binary")
    monkeypatch.setattr(Q, "encode_images", lambda spark, sf_dir: rows)
    want = {(i, *at): shade for i, (data, _, _) in enumerate(made) for at, shade in brute_pixels(Reader(data))[0].items()}
    assert want == {(i, *at): shade for i, (_, pixels, _) in enumerate(made) for at, shade in pixels.items()}
    got = Q.QUERIES["decode_streams"](spark, "").collect()
    assert len(got) == len(want) and {(r["image_id"], r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in got} == want


def brute_crc64(data):
    state = 2**64 - 1
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0xC96C5795D7870F42 if state & 1 else 0)
    return f"{state ^ (2**64 - 1):016X}"


def test_crc64_of_whole_texts(spark, tmp_path):
    texts = ["", None, "a", "abcdefgh", "Привет, мир", "日本語" * 200, "x" * 255, "x" * 256, "plain " * 300, "é" * 4 + "tail" * 500, "short"]
    rows = spark.createDataFrame([*enumerate(texts), (None, "no id"), (2, "twice")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, Q.crc64(spark, str(tmp_path)).collect()), key=str)
    want = [(i, t if t is None else brute_crc64(t.encode())) for i, t in map(tuple, rows.collect())]
    assert got == sorted(want, key=str) and dict(got)[0] == "0" * 16


@pytest.fixture
def two_images(spark, monkeypatch):
    """Two rasters of 64 x 16, as those of the embeddings are."""
    shades = np.random.default_rng(3).integers(0, 256, (2, 16, 64, 3))
    rows = [(i, y, x, *map(int, shades[i, y, x])) for i in range(2) for y in range(16) for x in range(64)]
    pixels = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    monkeypatch.setattr(Q, "emb", lambda spark, sf_dir: pixels)
    return shades


def test_palette_of_all_columns(spark, two_images):
    palette = np.array([[36 * i, 255 - 36 * i, 17 * i] for i in range(8)])
    d2 = ((two_images[:, :, :, None, :] - palette) ** 2).sum(axis=4)
    near = d2.argmin(axis=3)
    got = {(r["image_id"], r["y"], r["x"]): (r["idx"], r["d2"]) for r in Q.QUERIES["nearest_palette"](spark, "").collect()}
    assert got == {at: (near[at], d2[at].min()) for at in np.ndindex(2, 16, 64)}
    step = {(r["image_id"], r["idx"]): (r["pr"], r["pg"], r["pb"], r["c"]) for r in Q.QUERIES["palette_step"](spark, "").collect()}
    assert step.keys() == {(i, k) for i in range(2) for k in np.unique(near[i]).tolist()}
    for (i, k), (*centre, count) in step.items():
        mine = two_images[i][near[i] == k]
        assert count == len(mine) and np.allclose(centre, mine.mean(axis=0), atol=6e-5)


def test_ranges_and_parts_at_all_angles(spark, two_images):
    y, x = np.mgrid[0:16, 0:64]
    ranges = {(r["image_id"], r["angle"]): (r["low"], r["high"], r["line_quant"], r["num_lines"]) for r in Q.QUERIES["distance_range"](spark, "").collect()}
    sides = {(i, a): np.zeros((2, 16, 64), int) for i in range(2) for a in range(512)}
    for r in Q.QUERIES["split_line"](spark, "").collect():
        sides[r["image_id"], r["angle"]]["LR".index(r["side"]), r["y"], r["x0"] : r["x1"]] += 1
    assert len(ranges) == 1024
    for (i, a), found in sides.items():
        sn, cs = int(D.SIN[a]), int(D.COS[a])
        reach = cs * y + sn * x
        low, high = int(reach.min()), int(reach.max())
        quant = (2 * (high - low) + 15) // 30 if high - low > K.SCALE * 15 else K.SCALE
        assert ranges[i, a] == (low, high, quant, max(1, (high - low) // quant))
        d = 20 * sn + 5 * cs
        left = y * cs >= d if sn == 0 else x >= (2 * d + sn - 2 * y * cs) // (2 * sn)
        assert (found[0] == left).all() and (found[1] == ~left).all()


@needs_tables
def test_all_images_are_coded_as_reported(spark):
    """Each stream keeps to the target, and its pixels are as far from the image as the encoder says."""
    images = Q.all_images(spark, SF).cache()
    coded = Q.QUERIES["encode_images"](spark, SF).cache()
    assert coded.count() == images.select("image_id").distinct().count()
    sides = {r["image_id"]: (r["width"], r["height"]) for r in R.sizes(images).collect()}
    bad = {i for i, (w, h) in sides.items() if min(w, h) < 9}
    rows = {r["image_id"]: r for r in coded.collect()}
    assert {i for i, r in rows.items() if r["status"] != "ok"} == bad and all(len(r["data"]) <= 200 for i, r in rows.items() if i not in bad)
    assert len({(r["variant_id"], r["color"]) for r in rows.values() if r["status"] == "ok"}) >= 3
    shown = D.decode_images(coded.select("image_id", "data")).withColumnsRenamed({c: f"d{c}" for c in "rgb"})
    error = sum((F.col(c) - F.col(f"d{c}")) * (F.col(c) - F.col(f"d{c}")) for c in "rgb")
    found = images.join(shown, ["image_id", "y", "x"]).groupBy("image_id").agg((F.sum(error) / F.count(F.lit(1))).alias("mse"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["image_id"] for r in found} == set(rows) - bad
    for r in found:
        assert r["n"] == sides[r["image_id"]][0] * sides[r["image_id"]][1] and abs(r["mse"] - rows[r["image_id"]]["mse"]) <= 1e-3 * r["mse"] + 1e-3

"""Searches in rounds, recursions, folds and combined sums, against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import checksum
from rastermill.functions import dimensions as D
from rastermill.operators import encode, frontier, rates, streams
from rastermill.operators import entropy as E
from rastermill.operators import palette as P
from rastermill.operators import rasters as R
from rastermill.operators import splits as S
from rastermill.operators.decode import walk
from rastermill.operators.tree import coding_jobs
from tests.test_whole_jobs import brute_crc64, brute_pixels, made_streams

VARIANT = "variant_id int, partition_code int, line_limit int, color_options long"


def shapes(spark, width=26, height=22, count=2):
    """Images of a few flat parts and some noise."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(count):
        y, x = np.mgrid[0:height, 0:width]
        shade = 60 * ((x + (i + 2) * y) % 17 < 8) + 90 * (y > 9 + i) + 40 * (x * 2 > y + 9)
        shade = np.clip(shade + rng.integers(0, 12, shade.shape), 0, 255)
        rows += [(i, yy, xx, int(shade[yy, xx]), int(255 - shade[yy, xx]), int(shade[yy, xx] // 2)) for yy in range(height) for xx in range(width)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long").cache()


def test_bounds_change_no_result(spark):
    pixels = shapes(spark)
    options = sum(1 << c for c in (0, 3, 6, 12, 17, 19, 24))
    variants = spark.createDataFrame([(i, (i * 37) % 500, (i * 11) % 63, options) for i in range(14)], VARIANT)
    key = lambda r: r["image_id"]
    whole = sorted(encode.encode_images(pixels, variants, 70, first_round=14).collect(), key=key)
    rounds = sorted(encode.encode_images(pixels, variants, 70, first_round=2, growth=3).collect(), key=key)
    assert whole == rounds and all(r["status"] == "ok" and len(r["data"]) <= 70 for r in rounds)


def test_what_is_given_up(spark):
    """With a bound that a variant can't reach nothing of it is kept; with one that it just reaches the winner stays."""
    pixels = shapes(spark, count=1)
    good = R.guarded(R.sizes(pixels))
    search = encode.Search(good, pixels, 70)
    variants = spark.createDataFrame([(0, 215, 30, sum(1 << c for c in (0, 3, 6, 19, 24)))], VARIANT)
    jobs = coding_jobs(good, variants, 70)
    best = encode.first_best(encode.simulated_error(search.trials(jobs)[-1], encode.TRIAL)).first()
    close = encode.simulated_error(search.trials(jobs.withColumn("bound", F.lit(float(best["sqe"]))))[-1], encode.TRIAL)
    assert encode.first_best(close).first() == best
    assert search.trials(jobs.withColumn("bound", F.lit(float(best["sqe"]) * 1.5)))[1].count() == 0  # errors are below zero


def test_frontier_is_the_tree(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_SPANS", 40)  # several tasks an image
    pixels = shapes(spark)
    good = R.guarded(R.sizes(pixels))
    jobs = coding_jobs(good, spark.createDataFrame([(0, 215, 12, (1 << 17) - 1)], VARIANT), 14)
    rows = S.prefix_rows(R.prefix_sums(pixels))
    nodes, taken = frontier.frontier_trees(jobs, rows)
    from rastermill.operators import tree as T

    class Patient(T.Outlook):
        """Colours that never end."""

        def take(self, cost, leaves):
            pass

    monkeypatch.setattr(T, "Outlook", Patient)
    image = rows.toPandas()
    for job in jobs.toPandas().itertuples():
        grown = T.Tree(S.ImageScorer(image[image["image_id"] == job.image_id], exact=False), job)
        found = {r["node"]: (r["sr"], r["c"], r["angle_code"], r["line"]) for r in nodes.where(F.col("image_id") == job.image_id).collect()}
        assert found == {r[0]: (r[1], r[4], r[7], r[8]) for r in grown.rows}
        turns = {r["node"]: r["ordinal"] for r in taken.where(F.col("image_id") == job.image_id).collect()}
        assert turns == {r[0]: r[-1] for r in grown.rows if r[-1] is not None} and len(turns) > 4


def test_palettes_by_recursion(spark):
    """Against the kernel, and the kernel against a loop over patches."""
    rng = np.random.default_rng(2)
    rows, kernels = [], {}
    for key in range(6):
        colors, counts = rng.integers(0, 256, (20, 3)), rng.integers(1, 60, 20)
        rows += [(key, i, *map(float, colors[i]), float(counts[i]), *(float(c * counts[i]) for c in colors[i])) for i in range(20)]
        kernels[key] = P.choose_centres(colors.astype(np.float32), counts.astype(np.float32), (colors * counts[:, None]).astype(np.float32), 5)
        state, centres = 0x23DE605F, []
        while len(centres) < 5:
            if centres:
                for shift, left in ((13, True), (17, False), (5, True)):
                    state = (state ^ (state << shift if left else state >> shift)) & (1 << 32) - 1
            weights = [int(n) * (min(sum((int(a) - int(b)) ** 2 for a, b in zip(c, q, strict=True)) for q in centres) if centres else 1) for c, n in zip(colors, counts, strict=True)]
            partial, at = 0, 0
            while at < 19 and (partial := partial + weights[at]) < sum(weights) * (state >> 9) / 8388608:
                at += 1
            centres.append(colors[at].tolist())
        last = float("inf")
        while True:
            near = [min(range(5), key=lambda k: (sum((a - b) ** 2 for a, b in zip(c, centres[k], strict=True)), k)) for c in colors.tolist()]
            error = sum(sum((a - b) ** 2 for a, b in zip(c, centres[k], strict=True)) * n for c, k, n in zip(colors.tolist(), near, counts.tolist(), strict=True))
            centres = [[sum(c[d] * n for c, k, n in zip(colors.tolist(), near, counts.tolist(), strict=True) if k == i) / max(1, sum(n for k, n in zip(near, counts.tolist(), strict=True) if k == i)) for d in range(3)] for i in range(5)]
            if last - error < 1:
                break
            last = error
        assert np.abs(kernels[key] - np.floor(np.array(centres) + 0.5)).max() == 0
    patches = spark.createDataFrame(rows, "image_id long, seq int, r double, g double, b double, c double, wr double, wg double, wb double")
    found = rates.palette_rounds(rates.palette_seeds(patches, ["image_id"], 5), ["image_id"]).collect()
    assert {r["image_id"]: np.floor(np.array([[q["r"], q["g"], q["b"]] for q in r["centres"]]) + 0.5).tolist() for r in found} == {k: v.tolist() for k, v in kernels.items()}


def test_nodes_of_streams(spark):
    made = made_streams()[:3]
    rows = spark.createDataFrame([*((i, bytearray(data)) for i, (data, _, _) in enumerate(made)), (9, None)], "image_id long, data binary")
    found = {i: [] for i in range(3)}
    for r in streams.stream_nodes(rows).collect():
        found[r["image_id"]].append(r)
    for i, (data, pixels, head) in enumerate(made):
        leaves = [r for r in found[i] if r["r"] is not None]
        assert sum(r["pixels"] for r in leaves) == len(pixels) and {(r["r"], r["g"], r["b"]) for r in leaves} == set(pixels.values())
        inner = [r for r in found[i] if r["r"] is None]
        assert len(inner) == head["splits"] and [(r["node"], r["level"], r["angle"], r["line"]) for r in inner] == [(n, *at) for n, _, color, *at in walk(data)[1] if color is None]
    assert brute_pixels(E.Reader(made[0][0]))[0] == made[0][1]


def test_pixels_and_leaves(spark):
    leaves = spark.createDataFrame([(0, 0, 0, 70, "a"), (0, 0, 70, 71, "b"), (0, 0, 71, 100, "c"), (0, 1, 5, 5, "none"), (1, 0, 31, 33, "d")], "image_id long, y long, x0 long, x1 long, leaf string")
    pixels = spark.range(100).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).cast("long").alias("y"), F.col("id").alias("x"))
    held = streams.leaf_of_pixel(pixels, leaves)
    assert {r["x"]: r["leaf"] for r in held.collect()} == {x: "a" if x < 70 else "b" if x == 70 else "c" for x in range(100)} and held.count() == 100
    assert "NestedLoop" not in held._jdf.queryExecution().executedPlan().toString()


def test_native_coder(spark):
    rnd = random.Random(6)
    lists = [[(rnd.randrange(m), m) for m in (rnd.choice((1, 2, 3, 7, 49, 256, 2048)) for _ in range(rnd.randint(0, 25)))] for _ in range(12)] + [[], [(0, 1)], [(0, 2)] * 9, [(0, 3)] * 40]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(lists)], f"id long, entries {E.ENTRY}")
    coded = streams.encode_native(rows, "id")
    assert "Python" not in coded._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: bytes(r["data"]) for r in coded.collect()} == {i: E.encode([v for v, _ in e], [m for _, m in e]) for i, e in enumerate(lists)}


def test_budgets(spark):
    costs = spark.createDataFrame([(1, 0, 5.0), (1, 1, 0.0), (1, 2, 7.5), (2, 0, 1.0)], "id long, ordinal int, cost double")
    budgets = spark.createDataFrame([(i, b) for i in (1, 2, 3) for b in (0.5, 5.0, 12.5, 99.0)], "id long, budget double")
    found = {(r["id"], r["budget"]): r["n"] for r in rates.rate_curve(costs, budgets, ["id"]).collect()}
    assert found == {(1, 0.5): 0, (1, 5.0): 2, (1, 12.5): 3, (1, 99.0): 3, (2, 0.5): 0, (2, 5.0): 1, (2, 12.5): 1, (2, 99.0): 1, **{(3, b): 0 for b in (0.5, 5.0, 12.5, 99.0)}}


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_of_ordered_texts(spark, parts):
    rnd = random.Random(9)
    texts = [(rnd.choice(["a", "b", None]), i if rnd.random() < 0.95 else None, rnd.choice([None, "", "é" * rnd.randint(1, 300), "text " * rnd.randint(0, 200)])) for i in range(120)]
    shuffled = spark.createDataFrame(rnd.sample(texts, len(texts)), "lang string, id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = {r["lang"]: (r["n_texts"], r["n_bytes"], r["crc"]) for r in checksum.ordered_crc64(shuffled, ["lang"], "id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for lang in ("a", "b", None):
        mine = sorted(((i is not None, i or 0, t is not None, t or "") for g, i, t in texts if g == lang), key=lambda r: (r[0], r[1], r[2], r[3].encode()))
        data = "".join(t for *_, t in mine).encode()
        assert found[lang] == (len(mine), len(data), brute_crc64(data))
    assert checksum.ordered_crc64(shuffled.limit(0), ["lang"], "id", "text").count() == 0


def test_all_variants_have_jobs(spark):
    images = spark.createDataFrame([(0, 20, 20)], "image_id long, width long, height long")
    assert coding_jobs(images, D.all_variants(spark), 200).count() == 31_500

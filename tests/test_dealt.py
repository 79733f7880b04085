"""Kernels take many trees, images and streams a task, in tasks by what there is to compute; against one at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from rastermill.operators import decode as D
from rastermill.operators import encode
from rastermill.operators import palette as P
from rastermill.operators import rasters as R
from rastermill.operators import splits as S
from rastermill.operators import tree as T
from rastermill.plans import queries as Q
from tests.test_whole_jobs import made_streams


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_trees(count):
    """Nodes of trees with few scores, some that can't be split, and a budget for each."""
    rnd = random.Random(4)
    nodes, jobs = [], []
    for i in range(count):
        for k in range(1, rnd.choice((2, 8, 32))):
            inner = rnd.random() < 0.8
            nodes.append((i, i % 3, bin(k)[3:].translate({48: "L", 49: "R"}), float(rnd.randint(1, 4)) if inner else None, rnd.randint(4, 40) / 4 if inner else None))
        jobs.append((i, i % 3, rnd.uniform(3, 60)))
    return nodes, jobs


def test_many_trees_a_task(spark, monkeypatch):
    monkeypatch.setattr(T, "TREES_A_TURN", 7)
    nodes, jobs = some_trees(60)
    rows = spark.createDataFrame(random.Random(1).sample(nodes, len(nodes)), "image_id long, variant_id int, node string, score double, cost double")
    taken = T.taken_splits(rows, spark.createDataFrame([*jobs, (99, 0, 5.0)], "image_id long, variant_id int, budget double"))
    want = set()
    for image, variant, budget in jobs:
        known = {n: (T.UNSPLIT if s is None else s, np.float32(1 + (c or 0))) for i, _, n, s, c in nodes if i == image}
        heap, left, turn = T.PairingHeap(), np.float32(budget), 0
        heap.push(known[""][0], "")
        while heap.top and (at := heap.pop())[0] >= 0:
            if known[at[1]][1] <= left:
                left -= known[at[1]][1]
                want.add((image, variant, at[1], turn))
                turn += 1
                for child in (at[1] + "L", at[1] + "R"):
                    if child in known:
                        heap.push(known[child][0], child)
    assert set(map(tuple, taken.collect())) == want and len(want) > 100
    assert "MapInArrow" in plan_of(taken) and "FlatMapGroups" not in plan_of(taken)  # no group of its own for each tree


def test_patches_search_the_trees_once(spark, tmp_path):
    spark.range(1, 40).select((F.col("id") * 3).alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    found = Q.tree_patches(spark, str(tmp_path))
    assert "InPandas" not in plan_of(found) and "InArrow" not in plan_of(found)  # the splits are read
    nodes = {(r["image_id"], r["node"]): r for r in Q.small_trees(spark, str(tmp_path)).collect()}
    order = {(r["image_id"], r["node"]): r["ordinal"] for r in Q.tree_splits(spark, str(tmp_path)).collect()}
    want = {}
    for color in (1, 2, 3):
        for (image, node), at in order.items():
            for side, name in enumerate((node + "L", node + "R")):
                if at < color and order.get((image, name), color) >= color:
                    row = nodes[image, name]
                    want[image, color, name] = (2 * at + side, *(row[f"s{c}"] / row["c"] for c in "rgb"), row["c"])
    got = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert got.keys() == want.keys() and len(want) > 100 and all(np.allclose(got[k], want[k], rtol=0, atol=6e-5) for k in want)


VARIANT = "variant_id int, partition_code int, line_limit int, color_options long"


def some_images(spark, count=5):
    """Images of a few flat parts, the last one larger than the others."""
    rows = []
    for i in range(count):
        side = 40 if i == count - 1 else 10 + i
        rows += [(i, y, x, 40 * ((x + i * y) % 7 < 4), 90 * (y > 4 + i), 10 * i + 60 * (x > 5)) for y in range(side) for x in range(side + 2)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long").coalesce(1)


def test_images_share_lots(spark, monkeypatch, tmp_path):
    """The same trees from lots of one part, of some, and of nearly all, each in several tasks."""
    pixels = some_images(spark)
    jobs = T.coding_jobs(R.guarded(R.sizes(pixels)), spark.createDataFrame([(i, 215 - i, 6 + i, 1 << 18 | 7) for i in range(3)], VARIANT), 40).cache()
    rows = S.prefix_rows(R.prefix_sums(pixels)).cache()
    monkeypatch.setattr(T, "VARIANTS_A_PART", 2)
    found, groups = [], []
    for work in (1, 2000, 1 << 30):
        monkeypatch.setattr(T, "LOT_WORK", work)
        monkeypatch.setattr(T, "tasks", lambda spark, n=1 if work > 2000 else 4: n)
        nodes = T.build_trees(jobs, rows, str(tmp_path / f"{work}"))
        groups.append(nodes.select(F.input_file_name()).distinct().count())
        found.append(sorted(map(str, nodes.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    assert groups[0] > 2  # a few kilobytes, but not one task


def test_one_round_is_coded_from_its_trials(spark, monkeypatch):
    pixels, calls, trials = some_images(spark, 3), [], encode.Search.trials
    variants = spark.createDataFrame([(0, 215, 6, 1 << 18 | 16), (1, 120, 9, 1 << 4)], VARIANT)
    monkeypatch.setattr(encode.Search, "trials", lambda self, jobs: calls.append(1) or trials(self, jobs))
    once = encode.encode_images(pixels, variants, 60).collect()
    assert len(calls) == 1
    twice = encode.encode_images(pixels, variants, 60, first_round=1).collect()
    assert len(calls) == 4 and sorted(map(str, once)) == sorted(map(str, twice)) and all(r["status"] == "ok" for r in once)


def test_streams_are_dealt_out(spark):
    made = made_streams()
    rows = spark.createDataFrame([(None if i == 7 else i, bytearray(made[i % 5][0]) if i != 3 else None) for i in range(40)], "image_id long, data binary").coalesce(1)
    for found in (D.decode_images(rows), D.read_headers(rows)):
        assert found.rdd.getNumPartitions() >= 16
    spans = D.decode_spans(rows).collect()
    count = {}
    for r in spans:
        count[r["image_id"]] = count.get(r["image_id"], 0) + r["x1"] - r["x0"]
    assert count == {None if i == 7 else i: len(made[i % 5][1]) for i in range(40) if i != 3}
    assert {r["leaf"] for r in spans if r["image_id"] == 0} == set(range(sum(c is not None for _, _, c, *_ in D.walk(made[0][0])[1])))


def test_many_palettes_a_task(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for key in range(30):
        n, size = int(rng.integers(1, 40)), int(rng.integers(1, 9))
        colors, counts = rng.integers(0, 256, (n, 3)), rng.integers(1, 60, n)
        rows += [(key, size, i, *map(float, colors[i]), float(counts[i]), *(float(c * counts[i]) for c in colors[i])) for i in range(n)]
        want[key] = P.choose_centres(colors.astype(np.float32), counts.astype(np.float32), (colors * counts[:, None]).astype(np.float32), size).tolist()
    patches = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "id long, palette int, seq int, r double, g double, b double, c double, wr double, wg double, wb double")
    found = P.build_palettes(patches, ["id"])
    assert "FlatMapGroups" not in plan_of(found)
    got = {}
    for r in found.orderBy("id", "idx").collect():
        got.setdefault(r["id"], []).append([r["pr"], r["pg"], r["pb"]])
    assert got == want


def test_line_scores_are_line_sums(spark, monkeypatch):
    """Regions of several spans, in images whose sums fit one number or need two; one region a group, or many."""
    rng = np.random.default_rng(5)
    shades = [rng.integers(0, 256, (12, 15, 3)), 255 - rng.integers(0, 3, (70, 90, 3))]
    pixels = spark.createDataFrame([(i, y, x, *map(int, s[y, x])) for i, s in enumerate(shades) for y in range(len(s)) for x in range(s.shape[1])], "image_id long, y long, x long, r long, g long, b long")
    regions = {(0, "a"): [(0, 2, 9), (1, 0, 15), (4, 3, 4)], (0, "b"): [(y, 3, 12) for y in range(5, 12)], (0, "one"): [(3, 3, 4)], (1, "a"): [(y, y, 90) for y in range(70)], (1, "b"): [(0, 0, 90)]}
    spans = spark.createDataFrame([(i, n, y, a, b, 5, 21) for (i, n), rows in regions.items() for y, a, b in rows], "image_id long, node string, y long, x0 long, x1 long, angle_bits int, line_limit int")
    rows = S.prefix_rows(R.prefix_sums(pixels)).cache()
    assert {len(S.ImageScorer(image, False).packs) for _, image in rows.toPandas().groupby("image_id")} == {1, 2}
    names = ["image_id", "node", "angle_code", "line", "d", "num_lines", "l_c", "score"]
    want = sorted(map(tuple, S.line_sums(spans, pixels, ["image_id", "node"]).withColumn("score", S.split_score()).select(names).collect()))
    for most in (1, 8):
        monkeypatch.setattr(S, "LOT_REGIONS", most)
        found = S.line_scores(spans, rows, ["image_id", "node"])
        assert sorted(map(tuple, found.select(names).collect())) == want and len(want) > 500
    assert found.rdd.getNumPartitions() >= 16
    whole, best = S.best_splits(spans, R.prefix_sums(pixels), ["image_id", "node"])
    keys = ["image_id", "node", *S.SUMS, *S.BEST]
    dealt = S.scored_regions(spans, rows, ["image_id", "node"], lots=True)
    assert dealt.rdd.getNumPartitions() >= 16
    assert sorted(map(str, dealt.select(keys).collect())) == sorted(map(str, whole.join(best, ["image_id", "node"], "left").select(keys).collect()))


def test_all_lines_aren_t_exploded_pixels(spark):
    found = Q.split_scores_binned(spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroups" in plan_of(found) and "explode(cells" not in plan_of(found) and "explode(angles" not in plan_of(found)

"""The order of equal scores, and lines counted in one pass against lines tried one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions.dimensions import COS, SIN
from rastermill.operators import splits as S
from rastermill.operators.decode import lines_across
from rastermill.operators.tree import PairingHeap, taken_splits


def emptied(heap):
    out = []
    while heap.top:
        out.append(heap.pop()[1])
    return out


def test_equal_scores():
    heap = PairingHeap()
    heap.push(5.0, "root")
    for score, name in ((3.0, "L"), (4.0, "R")):
        heap.push(score, name)
    assert heap.pop() == (5.0, "root") and heap.pop() == (4.0, "R")
    # L has two children of equal score below a better one: the later one comes first.
    heap = PairingHeap()
    for score, name in ((9.0, "R"), (2.0, "LL"), (2.0, "LR")):
        heap.push(score, name)
    assert emptied(heap) == ["R", "LR", "LL"]
    heap = PairingHeap()
    for name in "abcd":
        heap.push(1.0, name)
    assert emptied(heap) == ["a", "d", "b", "c"]


def test_trees_of_equal_scores(spark):
    nodes = [(1, 0, n, s, c) for n, s, c in (("", 3.0, 1.0), ("L", 2.0, 1.0), ("R", 2.0, 1.0), ("LL", 1.0, 1.0), ("LR", 1.0, 1.0), ("RL", None, None), ("RR", 1.0, 9.0))]
    jobs = spark.createDataFrame([(1, 0, 11.0)], "image_id long, variant_id int, budget double")
    taken = taken_splits(spark.createDataFrame(nodes, "image_id long, variant_id int, node string, score double, cost double"), jobs).orderBy("ordinal").collect()
    assert [r["node"] for r in taken][:2] == ["", "L"] and sorted(r["node"] for r in taken) == ["", "L", "LL", "LR", "R"]


@pytest.mark.parametrize("exact", [True, False])
def test_lines_of_odd_regions(spark, exact):
    """Regions of several spans, two in one image, with holes between rows."""
    rng = np.random.default_rng(5)
    shades = rng.integers(0, 256, (2, 12, 15, 3))
    pixels = spark.createDataFrame([(i, y, x, *map(int, shades[i, y, x])) for i in range(2) for y in range(12) for x in range(15)], "image_id long, y long, x long, r long, g long, b long")
    regions = {(0, "a"): [(0, 2, 9), (1, 0, 15), (4, 3, 4)], (0, "b"): [(y, 3, 12) for y in range(5, 12)], (1, "a"): [(y, y, 15) for y in range(12)], (1, "one"): [(3, 3, 4)]}
    spans = spark.createDataFrame([(i, n, y, a, b, 6, 9) for (i, n), rows in regions.items() for y, a, b in rows], "image_id long, node string, y long, x0 long, x1 long, angle_bits int, line_limit int")
    found = {(r["image_id"], r["node"], r["angle_code"], r["line"]): tuple(r[c] for c in ("d", "num_lines", "l_sr", "l_sg", "l_sb", "l_c", "sr", "c")) for r in S.line_sums(spans, pixels, ["image_id", "node"], exact).collect()}
    expected = {}
    for (i, n), rows in regions.items():
        part = np.array(rows)
        y, x0, x1 = part.T
        for code in range(64):
            sn, cs = int(SIN[code * 8]), int(COS[code * 8])
            low, high, quant, lines = lines_across(part, sn, cs, 9, False)
            for line in range(lines):
                d = low + (high - low - (lines - 1) * quant) // 2 + quant * line if lines > 1 else (high + low) % 2**32 // 2
                at = S.edges(y, x0, x1, np.array(sn), np.array(cs), np.array(d), exact)
                left = sum((np.append(shades[i, yy, a:b].sum(axis=0), b - a) for yy, a, b in zip(y, at, x1, strict=True)), np.zeros(4, int))
                whole = sum((np.append(shades[i, yy, a:b].sum(axis=0), b - a) for yy, a, b in zip(y, x0, x1, strict=True)), np.zeros(4, int))
                if 0 < left[3] < whole[3]:
                    expected[i, n, code, line] = (d, lines, *left.tolist(), int(whole[0]), int(whole[3]))
    assert found == expected and len(found) > 1000


def test_plan_has_no_exploded_candidates(spark):
    spans = spark.createDataFrame([(0, 0, 0, 9, 4, 15)], "image_id long, y long, x0 long, x1 long, angle_bits int, line_limit int")
    pixels = spark.range(9).select(F.lit(0).cast("long").alias("image_id"), F.lit(0).cast("long").alias("y"), F.col("id").alias("x"), *(F.col("id").alias(c) for c in "rgb"))
    plan = S.line_sums(spans, pixels, ["image_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and "Python" not in plan  # angles, an image's rows, a region's angles

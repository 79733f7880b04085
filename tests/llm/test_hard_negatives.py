"""Hard negatives against every pair."""

import random

import pytest

from rastermill.llm import hard_negatives as H


def brute(rows, anchors, positives=5, negatives=5):
    """rows: {vec_id: (label, vector)}."""
    out = set()
    for a in anchors:
        scores = sorted((-sum(x * y for x, y in zip(rows[a][1], v, strict=True)), i) for i, (_, v) in rows.items() if i != a and len(v) == len(rows[a][1]))
        same = [(i, -s) for s, i in scores if rows[i][0] == rows[a][0]][:positives]
        for p, ps in same:
            found = [(i, -s) for s, i in scores if rows[i][0] != rows[a][0] and 80 * ps <= 100 * -s <= 100 * ps][:negatives]
            out |= {(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(found)}
    return out


def vectors(rnd, n, dim=6, kinds=3, size=40):
    middles = [[rnd.randint(-size, size) for _ in range(dim)] for _ in range(8)]
    rows = {}
    for i in range(n):
        c = rnd.choice(middles)
        rows[i] = (rnd.randrange(kinds), [float(x + rnd.randint(-9, 9)) for x in c])
    for i in range(3, n, 11):
        rows[i] = (rows[i][0], rows[2][1])  # many copies and ties
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, 7, "q") for i, (label, v) in rows.items()], "vec_id long, label int, vector array<double>, shard int, score string")


@pytest.mark.parametrize(("shard_rows", "slab"), [(16_384, 8_192), (60, 9)])
def test_every_pair(spark, monkeypatch, shard_rows, slab):
    monkeypatch.setattr(H, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(H, "SLAB_ANCHORS", slab)
    rows = vectors(random.Random(4), 700)
    found = H.hard_negatives(table(spark, rows), "vec_id % 20 = 0").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute(rows, range(0, 700, 20))


def test_few_rows_labels_and_dimensions(spark):
    rows = {0: (0, [1.0, 2.0]), 1: (0, [2.0, 2.0]), 2: (1, [2.0, 2.0]), 3: (1, [1.0, 1.0]), 4: (0, [5.0]), 5: (1, [4.0]), 6: (0, [-1.0, -2.0]), 7: (2, [0.0, 0.0])}
    found = {tuple(r) for r in H.hard_negatives(table(spark, rows), "vec_id >= 0").collect()}
    assert found == brute(rows, rows)
    assert H.hard_negatives(table(spark, rows).limit(0), "vec_id >= 0").count() == 0
    assert H.hard_negatives(table(spark, rows), "vec_id > 99").count() == 0


def test_scores_beyond_doubles(spark):
    big = float(2**40)
    rnd = random.Random(1)
    rows = {i: (i % 2, [big * rnd.randint(1, 3) + rnd.randint(0, 5) for _ in range(3)]) for i in range(40)}
    limit = 2**63
    expected = {(a, p, k, i, ps if ps < limit else None, s if s < limit else None) for a, p, k, i, ps, s in brute({i: (label, [int(x) for x in v]) for i, (label, v) in rows.items()}, range(0, 40, 8))}
    found = {tuple(r) for r in H.hard_negatives(table(spark, rows), "vec_id % 8 = 0").collect()}
    assert found == expected and any(r[4] is None for r in found)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [0.5, 0.25]), (1, None, [0.5, 0.5]), (2, 0, None), (3, 0, [nan, 1.0]), (4, 1, [inf, 1.0]), (5, 1, [None, 1.0]), (None, 1, [0.1, 0.1]), (6, 0, [0.5, 0.125]), (6, 1, [0.75, 0.125]), (7, 1, [0.25, 0.25]), (8, 1, [1e307, 1.0])]
    kept = {(r["vec_id"], r["label"], tuple(r["vector"])) for r in H.whole_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert kept == {(0, 0, (128.0, 64.0)), (6, 0, (128.0, 32.0)), (7, 1, (64.0, 64.0))}

import numpy as np
import pytest

from rastermill.llm import pivot_index, prefix_forest, queries
from tests.llm.helpers import SF, needs_tables

NAN = float("nan")
ODD = [(0, [0.5, -0.25]), (100, [0.5, -0.25]), (1, None), (2, [NAN, 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 3.0]), (7, [0.5, -0.25]), (None, [0.1, 0.1]), (300, []), (8, [-0.3, 0.9]), (8, [-0.3, 0.9])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    rows = (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 24))).astype(np.float32)
    rows[n // 3 : n // 2] = rows[0]  # a hot group of equal vectors
    return rows


def exact_top(ids, whole, k):
    out = []
    for q in np.flatnonzero(ids % 100 == 0):
        score = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), int(score[i])) for r, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [5, 1500])
def test_topk_is_exact(spark, n):
    data = clustered(n)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    got = pivot_index.top_k(pivot_index.integer_vectors(rows), "vec_id % 100 = 0", 10)
    assert sorted(map(tuple, got.collect())) == exact_top(np.arange(n), np.floor(data.astype(np.float64) * 1024).astype(np.int64), 10)


def test_topk_odd_rows(spark):
    got = pivot_index.top_k(pivot_index.integer_vectors(vectors(spark, ODD)), "vec_id % 100 = 0", 10).collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200, 300)}
    assert by == {0: [7, 100, 5, 8], 100: [0, 7, 5, 8], 200: [6], 300: []}
    assert pivot_index.top_k(pivot_index.integer_vectors(vectors(spark, [])), "vec_id % 100 = 0").count() == 0


@needs_tables
def test_neighbour_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, data = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    recall(queries.op10_neighbours(spark, SF).collect(), ids, data)


def test_neighbour_recall_larger(spark):
    data = clustered(6000, 4)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    recall(prefix_forest.nearest(prefix_forest.usable_vectors(rows), "vec_id % 100 = 0").collect(), np.arange(6000), data.astype(np.float64))


def test_pages_follow_the_measured_recall(spark, monkeypatch):
    """Directions without structure: recall holds, and what is read stays a part of the rows."""
    rng = np.random.default_rng(12)
    data = rng.normal(size=(20_000, 32)).astype(np.float32)
    rows = prefix_forest.usable_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]))
    search, settings, seen = prefix_forest.search_arrays, prefix_forest.settings, []

    def read(plants, usual, lengths, most):
        seen.append(search(plants, usual, lengths, 1 << 20).select("query_id", "vec_id").distinct().count())
        return search(plants, usual, lengths, most)

    def chosen(*args):
        seen.append(settings(*args))
        return seen[-1]

    monkeypatch.setattr(prefix_forest, "search_arrays", read)
    monkeypatch.setattr(prefix_forest, "settings", chosen)
    recall(prefix_forest.nearest(rows, "vec_id % 100 = 0").collect(), np.arange(20_000), data.astype(np.float64))
    assert seen[0][32] in prefix_forest.SETTINGS[3:-1] and seen[1] < 0.5 * 200 * 20_000


def test_places_are_counted_over_all_rows(spark):
    rng = np.random.default_rng(13)
    data = rng.normal(size=(700, 8)).astype(np.float32)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]).select("vec_id", prefix_forest.F.col("embedding").alias("vector"))
    own = [np.sort(prefix_forest.strings(data, r, prefix_forest.tie_order(np.arange(700), t))) for t, r in enumerate(prefix_forest.rotations(8, 2))]
    marks = {(8, t): np.unique(s[::7]) for t, s in enumerate(own)}
    got = prefix_forest.places(rows.repartition(3), {}, marks)
    assert all((got[8, t] == np.searchsorted(s, marks[8, t])).all() for t, s in enumerate(own))


def recall(got, ids, data):
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((ids, d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in mine)
        hit += len({int(ids[i]) for i in want} & {v for _, v, _ in mine})
        total += len(want)
    assert hit >= 0.9 * total


def test_neighbours_odd_rows(spark):
    got = prefix_forest.nearest(prefix_forest.usable_vectors(vectors(spark, ODD)), "vec_id % 100 = 0").collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200, 300)}
    assert by == {0: [7, 100, 8], 100: [0, 7, 8], 200: [6], 300: []}
    assert prefix_forest.nearest(prefix_forest.usable_vectors(vectors(spark, [])), "vec_id % 100 = 0").count() == 0


def test_neighbours_in_a_dense_cluster(spark):
    """A third of all rows agree in all but their last symbols."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(4000, 32))
    data[1000:2400] = data[1000] + 0.02 * rng.normal(size=(1400, 32))
    data = data.astype(np.float32)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    recall(prefix_forest.nearest(prefix_forest.usable_vectors(rows), "vec_id % 100 = 0").collect(), np.arange(4000), data.astype(np.float64))


def test_strings_of_near_vectors_share_prefixes():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    ties = np.zeros(500, np.int64)
    shared = lambda a, b: np.array([60 - int(v).bit_length() for v in a ^ b])
    for rotation in prefix_forest.rotations(16, 2):
        own = prefix_forest.strings(x, rotation, ties)
        near, far = prefix_forest.strings(x + 0.01 * x[::-1], rotation, ties), own[::-1]
        assert shared(own, near).mean() > shared(own, far).mean() + 10
        probes = prefix_forest.probe_strings(x, rotation, ties, 8, 2)
        assert (probes[:, 0] == own).all() and all(len(set(p)) == 8 for p in probes.tolist())


def test_pages_are_read_from_the_place_outwards():
    row = np.repeat(np.arange(10), 64)  # ten pages, each with its own prefix
    row[128:512] = 2
    who, page = prefix_forest.pages_read(np.array([300, 5, 300]), np.array([True, True, False]), np.array([2, 0, 2]), row, 10)
    assert sorted(zip(who.tolist(), page.tolist(), strict=True)) == [(0, p) for p in range(2, 8)] + [(1, 0), (2, 4)]


def test_topk_closes_early_on_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    data = centres[rng.integers(0, 30, 9000)] + 0.1 * rng.normal(size=(9000, 16))
    data = (data / np.linalg.norm(data, axis=1)[:, None]).astype(np.float32)
    write, read = pivot_index.Scratch.write, []

    def watched(self, df, name, *args, **kwargs):
        out = write(self, df, name, *args, **kwargs)
        if name.startswith("requests"):
            read.append(sum(r["n"] for r in out.select("n").collect()))
        return out

    monkeypatch.setattr(pivot_index.Scratch, "write", watched)
    got = pivot_index.top_k(pivot_index.integer_vectors(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])), "vec_id % 100 = 0", 10)
    assert sorted(map(tuple, got.collect())) == exact_top(np.arange(9000), np.floor(data.astype(np.float64) * 1024).astype(np.int64), 10)
    assert len(read) >= 3 and read[-1] == 0 and sum(read) < 0.5 * 90 * 9000

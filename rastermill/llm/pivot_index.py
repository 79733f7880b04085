"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more component that brings all to the same length, so that the largest
inner product is the smallest distance. Each is filed under its nearest pivot, sorted by the
distance to it, and a pivot's rows are cut into annuli (rings) of about equal size. A query takes
the rings in the order of the least distance that the triangle inequality leaves possible
there, in rounds of growing size; its k-th score so far closes it when no ring that is left
can hold a better one.

Vectors too long for exact 64-bit arithmetic are not indexed: as candidates every query searches
them, as queries they search all rows, in blocks, with doubtful scores as Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import Scratch
from rastermill.llm.vectors import best_of_pairs, block_rows, by_dimension, finite, first_copies, one_each, to_blocks, top

DATA_BLOCK, QUERY_BLOCK, RING_ROWS, MOST_PIVOTS, MOST_RINGS = 1024, 256, 256, 2048, 32
FIRST_ROWS, GROWTH = 512, 8
LARGEST = 2.0**52


def integer_vectors(df: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, vector array<double>): floor(scale * x), whole numbers that a double holds exactly.
    Vectors null or with a null or non-finite component take no part."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return df.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.transform("embedding", whole).alias("vector"))


def squared_length(vector: Column) -> Column:
    """Exact for sums of at most 2**53."""
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


class Index:
    """Pivots, the common length, and what rings there are; small, and sent to every task."""

    def __init__(self, pivots: list[list[float]], length: float):
        self.pivots, self.length = pivots, max(length, 1.0)
        self.slack = 1e-6 * self.length  # of distances, for differences of near squares lose half their digits
        self.rings: dict[int, np.ndarray] = {}  # dim -> rows (pivot, ring, least and largest distance, rows)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To each pivot, in the space with the added component (0 for queries)."""
        p = np.zeros((len(self.pivots), x.shape[1]))
        for i, v in enumerate(self.pivots):
            n = min(len(v), x.shape[1])
            p[i, :n] = v[:n]
        lift = lambda y: np.sqrt(np.maximum(self.length**2 - (y**2).sum(axis=1), 0))
        own = np.zeros(len(x)) if query else lift(x)
        square = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T + (own[:, None] - lift(p)[None, :]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def order(self, d: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one query, by its distances to the pivots: the rings in the order in which it takes them, and the
        least distance that a row of each may have. A row is no nearer than its ring's gap, and, as it is
        nearest to its own pivot, no nearer than half of what that is further than the query's nearest."""
        to = d[rings[:, 0].astype(int)]
        gap = np.maximum(np.maximum(to - rings[:, 3], rings[:, 2] - to), (to - d.min()) / 2)
        least = np.maximum(gap - self.slack, 0)
        at = np.lexsort((rings[:, 1], to, least))
        return at, least[at]


def filed(rows: DataFrame, index: Index, dtype: str) -> DataFrame:
    """(dim, pivot, distance, id, vector binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_dimension(batch, 1):
                d = index.distances(x, query=False)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), batch.column(0).take(pa.array(at)), pa.array([v.astype(dtype).tobytes() for v in x], pa.binary())],
                    ["dim", "pivot", "distance", "id", "vector"],
                )

    return rows.select("vec_id", "vector").mapInArrow(run, "dim int, pivot int, distance double, id long, vector binary")


def with_rings(rows: DataFrame, index: Index) -> DataFrame:
    """Adds `ring` to filed rows, cut at the quantiles of each pivot's distances, and notes in the index
    how far each reaches."""
    cells = rows.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", F.array(*(F.lit(i / MOST_RINGS) for i in range(1, MOST_RINGS))), F.lit(1000)).alias("cuts"))
    cuts = {}
    for r in cells.collect():  # a row for each pivot
        count = min(MOST_RINGS, -(-r["n"] // RING_ROWS))
        cuts[r["dim"], r["pivot"]] = np.array(r["cuts"])[[i * MOST_RINGS // count - 1 for i in range(1, count)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, pivot, distance = (batch.column(i).to_numpy() for i in range(3))
            ring = np.zeros(len(dim), np.int32)
            for cell in set(zip(dim.tolist(), pivot.tolist(), strict=True)):
                mine = (dim == cell[0]) & (pivot == cell[1])
                ring[mine] = np.searchsorted(cuts[cell], distance[mine], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], [*batch.schema.names, "ring"])

    out = rows.mapInArrow(run, "dim int, pivot int, distance double, id long, vector binary, ring int")
    reach = out.groupBy("dim", "pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).collect()  # MOST_RINGS rows a pivot
    for dim in {r["dim"] for r in reach}:
        index.rings[dim] = np.array(sorted((r["pivot"], r["ring"], r["low"], r["high"], r["n"]) for r in reach if r["dim"] == dim))
    return out


def requests(queries: DataFrame, index: Index, budget: int, dtype: str) -> DataFrame:
    """queries: (vec_id, vector, least, done): `least` is the k-th score so far (null: fewer), `done` the number
    of rings taken. (dim, pivot, ring, id, vector, done, n): the next rings of each, of about `budget` rows; none
    for a query that is closed. `n` is the number of a ring's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, least, done = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for at, x in by_dimension(batch, 1):
                rings = index.rings.get(x.shape[1])
                if rings is None:
                    continue
                d = index.distances(x, query=True)
                for row, i in enumerate(at):
                    order, near = index.order(d[row], rings)
                    reach = np.inf
                    if least[i] is not None:
                        reach = math.sqrt(max(float((x[row] ** 2).sum()) + index.length**2 - 2.0 * least[i], 0.0)) + index.slack
                    open_ = int(np.searchsorted(near, reach, side="right"))
                    sizes = np.cumsum(rings[order[done[i] : open_], 4])
                    took = min(len(sizes), int(np.searchsorted(sizes, budget)) + 1)
                    if not took:
                        continue
                    chosen = rings[order[done[i] : done[i] + took]]
                    full = lambda v, t, n=took: pa.array([v] * n, t)
                    yield pa.RecordBatch.from_arrays(
                        [full(x.shape[1], pa.int32()), pa.array(chosen[:, 0].astype(np.int32)), pa.array(chosen[:, 1].astype(np.int32)), full(ids[i], pa.int64()), full(x[row].astype(dtype).tobytes(), pa.binary()), full(done[i] + took, pa.int32()), pa.array(chosen[:, 4].astype(np.int64))],
                        ["dim", "pivot", "ring", "id", "vector", "done", "n"],
                    )

    return queries.select("vec_id", "vector", "least", "done").mapInArrow(run, "dim int, pivot int, ring int, id long, vector binary, done int, n long")


def negative_product(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    return -(q @ x.T), 0.0


def sort_key(n: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (abs(n).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return b"\x01" + data if n >= 0 else b"\x00" + bytes(255 - b for b in data)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, so that no product overflows."""
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -power[:, None])


def keyed_batch(queries: list[int], vecs: list[int], scores: list[int]) -> pa.RecordBatch:
    fits = [s if -(2**63) <= s < 2**63 else None for s in scores]
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(vecs, pa.int64()), pa.array(fits, pa.int64()), pa.array([sort_key(s) for s in scores], pa.binary())], ["query_id", "vec_id", "score", "key"])


KEYED = "query_id long, vec_id long, score long, key binary"


def best_exact(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: (q_ids, q_matrix, ids, matrix). For each pair of blocks and query at least its `k` first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_matrix, ids, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, q = block_rows(q_ids, q_matrix, "<f8")
                rows, x = block_rows(ids, matrix, "<f8")
                unit = np.ldexp(x, -np.frexp(np.abs(x).max(initial=0))[1])  # one power for all rows, for they are compared
                near = scaled(q)
                cost = -(near @ unit.T)
                error = (q.shape[1] + 4) * 2.0**-52 * (1 + np.linalg.norm(near, axis=1)[:, None]) * np.linalg.norm(unit, axis=1)[None, :] + 1e-290
                own = names[:, None] == rows[None, :]
                at = min(k, len(rows)) - 1
                edge = np.partition(np.where(own, np.inf, cost + error), at, axis=1)[:, at : at + 1]
                who, which = np.nonzero((cost - error <= edge) & ~own)
                left = {i: [int(v) for v in q[i]] for i in set(who.tolist())}
                right = {i: [int(v) for v in x[i]] for i in set(which.tolist())}
                scores = [sum(a * b for a, b in zip(left[i], right[j], strict=True)) for i, j in zip(who.tolist(), which.tolist(), strict=True)]
                best: dict[int, list[tuple[int, int]]] = {}
                for i, j, s in zip(who.tolist(), which.tolist(), scores, strict=True):
                    best.setdefault(i, []).append((-s, int(rows[j])))
                kept = [(int(names[i]), j, -s) for i, found in best.items() for s, j in sorted(found)[:k]]
                yield keyed_batch(*map(list, zip(*kept, strict=True))) if kept else keyed_batch([], [], [])

    return pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(run, KEYED)


def keyed(found: DataFrame) -> DataFrame:
    """Found rows with the key of their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield keyed_batch(*(c.to_pylist() for c in batch.columns))

    return found.select("query_id", "vec_id", "score").mapInArrow(run, KEYED)


def plain_rows(rows: DataFrame) -> DataFrame:
    """(dim, id, vector binary) of (vec_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in vectors], pa.int32()), batch.column(0), pa.array([np.array(v, "<f8").tobytes() for v in vectors], pa.binary())], ["dim", "id", "vector"])

    return rows.select("vec_id", "vector").mapInArrow(run, "dim int, id long, vector binary")


def search_all(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Every query against every candidate of its dimension. Candidates are dealt into parts of about a
    block, so that no task has them all."""
    parts = max(1, -(-candidates.count() // DATA_BLOCK))
    keys = ["dim", "part"]
    blocks = to_blocks(plain_rows(candidates).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), keys, DATA_BLOCK, "<f8")
    asked = plain_rows(queries).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = to_blocks(asked, keys, QUERY_BLOCK, "<f8").withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
    return best_exact(blocks.join(asked, keys), k)


def top_k(vectors: DataFrame, query_where: str, k: int = 10, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score long): for each row of `vectors` (vec_id, vector of whole
    numbers) that satisfies `query_where` its `k` largest inner products with other rows, ties to
    the smaller vec_id. Ranks are exact for vectors of any length; a score beyond 64 bits is null.

    Rows without vec_id take no part; of rows that share a vec_id the least vector counts; only
    vectors of the same dimension are compared. Fewer candidates than `k` give fewer rows; an empty
    table gives none. Other columns are not read. The pivots (a quarter of the square root of the
    number of rows, or `pivots`) are those rows whose hashed ids are least; any choice gives right
    results. A query takes FIRST_ROWS rows, then GROWTH times as many in each round.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = scratch.write(one_each(vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))), "vectors")
    fits = squared_length(F.col("vector")) < LARGEST
    rows, large = whole.where(fits), whole.where(~fits)
    total = rows.agg(F.max(squared_length(F.col("vector"))).alias("square"), F.max(F.array_max(F.transform("vector", F.abs))).alias("part"), F.count(F.lit(1)).alias("n")).first()
    dtype = "<f4" if (total["part"] or 0) < 2**24 else "<f8"  # whole numbers, exact in either
    count = pivots or min(MOST_PIVOTS, math.ceil(total["n"] ** 0.5 / 4) + 3)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()  # `count` rows
    index = Index([r["vector"] for r in chosen], float(total["square"] or 0) ** 0.5)
    keys = ["dim", "pivot", "ring"]
    cells = with_rings(scratch.write(filed(first_copies(rows, k + 1), index, dtype), "filed"), index)
    blocks = scratch.write(to_blocks(cells, keys, DATA_BLOCK, dtype), "blocks")
    scratch.drop("filed")

    queries = rows.where(query_where)
    state = queries.select(F.col("vec_id").alias("id"), F.lit(0).alias("done"))
    found, budget, step = None, FIRST_ROWS, 0
    while True:
        asked = queries.join(state.withColumnRenamed("id", "vec_id"), "vec_id").withColumn("least", F.lit(None).cast("long"))
        if found is not None:
            asked = asked.drop("least").join(found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")), "vec_id", "left")
        due = scratch.write(requests(asked, index, budget, dtype), f"requests-{step}")
        if due.isEmpty():
            break
        grouped = to_blocks(due, keys, QUERY_BLOCK, dtype).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
        new = best_of_pairs(blocks.join(grouped, keys), negative_product, k, dtype, "inner")
        if found is not None:
            new = new.unionByName(found.select("query_id", "vec_id", "score"))
        found = scratch.write(top(new, k, F.col("score").desc()), f"found-{step}")
        state = scratch.write(due.groupBy("id").agg(F.max("done").alias("done")), f"state-{step}")
        step, budget = step + 1, budget * GROWTH
    if found is None:
        found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if large.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    # Each pair with a large row stands in one of these.
    found = keyed(found).unionByName(search_all(whole.where(query_where), first_copies(large, k + 1), k))
    found = found.unionByName(search_all(large.where(query_where), first_copies(rows, k + 1), k))
    return top(found, k, F.col("key").desc())

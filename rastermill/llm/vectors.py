"""Vectors as rows and as blocks (matrices of rows that share a key)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def one_each(df: DataFrame) -> DataFrame:
    """A row for each vec_id that isn't null; of several the one with the least vector."""
    return df.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("vector").alias("vector"))


def first_copies(df: DataFrame, most: int) -> DataFrame:
    """Of rows with equal vectors the `most` with the least vec_id: more can never be among a
    query's `most` - 1 nearest. Spark limits each group before the shuffle as well as after."""
    w = Window.partitionBy("vector").orderBy("vec_id")
    return df.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= most).drop("_copy")


def to_blocks(rows: DataFrame, keys: list[str], most: int, dtype: str) -> DataFrame:
    """rows: (*keys, id, vector binary) -> (*keys, ids binary, matrix binary): runs of at most `most`
    rows of one key. Rows are range-sorted by key and id, so a hot key spans several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, ids, vectors = None, [], []

        def out() -> pa.RecordBatch:
            block = [pa.array([k]) for k in held_key] + [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())]
            return pa.RecordBatch.from_arrays(block, [*keys, "ids", "matrix"]).cast(schema)

        for batch in batches:
            for *key, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != held_key or len(ids) == most):
                    yield out()
                    ids, vectors = [], []
                held_key = key
                ids.append(vec_id)
                vectors.append(vector)
        if ids:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [rows.schema[k] for k in keys]
    out_schema = type(rows.schema)(fields).add("ids", "binary").add("matrix", "binary")
    schema = to_arrow_schema(out_schema)
    ranged = rows.select(*keys, "id", "vector").repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id")
    return ranged.mapInArrow(run, out_schema)


def by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch with vectors of one dimension: their places, and a matrix."""
    vectors = batch.column(column).to_pylist()
    dims = np.array([len(v) for v in vectors])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, np.array([vectors[i] for i in at], np.float64).reshape(len(at), d)


def block_rows(ids: bytes, matrix: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(matrix, dtype).reshape(len(names), -1).astype(np.float64)


HELD_ROWS = 200_000


def first_of_each(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int, sign: int) -> tuple[np.ndarray, ...]:
    """The `k` first rows of each query by sign * score, ties to the smaller vec_id, each pair once."""
    order = np.lexsort((vec, sign * score, query))
    query, vec, score = query[order], vec[order], score[order]
    fresh = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])][: len(query)]
    query, vec, score = query[fresh], vec[fresh], score[fresh]
    at = np.arange(len(query))
    begin = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]][: len(query)], at, 0)) if len(query) else at
    keep = at - begin < k
    return query[keep], vec[keep], score[keep]


def best_of_pairs(pairs: DataFrame, rank: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], k: int, dtype: str, score: str) -> DataFrame:
    """pairs: (q_ids, q_matrix, ids, matrix). For each task and query its `k` first rows, as
    (query_id, vec_id, score). `rank` gives two queries x rows matrices: costs (least first,
    ties included at the k-th) and a slack within which a cost isn't certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, ...]:
            return first_of_each(*(np.concatenate(c) for c in zip(*held, strict=True)), k, -1 if score == "inner" else 1)

        for batch in batches:
            for q_ids, q_matrix, ids, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, q = block_rows(q_ids, q_matrix, dtype)
                rows, x = block_rows(ids, matrix, dtype)
                cost, slack = rank(q, x)
                cost = np.where(names[:, None] == rows[None, :], np.inf, cost)
                at = min(k, len(rows)) - 1
                edge = np.partition(cost, at, axis=1)[:, at : at + 1]
                who, which = np.nonzero((cost <= edge + slack) & np.isfinite(cost))
                held.append((names[who], rows[which], exact_score(q[who], x[which])))
                size += len(who)
                if size > HELD_ROWS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "vec_id", "score"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], ["query_id", "vec_id", "score"])

    exact_score = SCORES[score]
    kind = "long" if score == "inner" else "double"
    return pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def _inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q.astype(np.int64) * x.astype(np.int64)).sum(axis=1)


def _euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((q - x) ** 2).sum(axis=1))


SCORES = {"inner": _inner, "euclidean": _euclidean}


def top(found: DataFrame, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the first `k` of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

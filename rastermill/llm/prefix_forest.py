"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long string of symbols: for each of several random rotations the axis, with
its sign, that the vector leans to most. A tree is an array of rows sorted by string. A query
descends with its own string, and with those strings that it would have had but for the least
change, to the page of rows around its place, which are those with the longest common prefixes.
Where rows lie so dense that pages further off still share a longer prefix than usual, it ascends
from its own place through these too, in all trees alike. Rows in the arrays carry their vector
in two bytes a component, which ranks a page's rows; the first of these get their exact distance
from the vectors themselves.

How many strings a query tries and how long pages are follows the table: for a sample of queries the exact
nearest rows are sought among all rows, their places in the arrays are counted, and the least
setting is taken that would have read TARGET of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.llm.common import Scratch
from rastermill.llm.shingles import U, scramble
from rastermill.llm.vectors import by_dimension, finite, first_copies, first_of_each, one_each

TREES, PROBES, PAGE, FIT_ROWS = 12, 36, 64, 2000
TARGET, CHECK_QUERIES = 0.95, 64
LENGTHS = (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384)
SETTINGS = [(4, 16), (8, 16), (16, 16)] + [(PROBES, length) for length in LENGTHS]  # strings tried, rows a page
SYMBOLS, AXES, RIVALS, KEPT, TIE_BITS = 6, 64, 8, 4, 20
ROW, OWN, PROBE = 0, 1, 2
TASK_ROWS, BUFFER_ROWS, HELD_ROWS, CELLS = 200_000, 1 << 16, 400_000, 1 << 22


def usable_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, vector) without vectors that are null, zero or not finite."""
    some = F.exists("embedding", lambda x: x != 0)
    return df.where(finite(F.col("embedding")) & F.coalesce(some, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))


@lru_cache(maxsize=4)
def rotations(dim: int, trees: int) -> np.ndarray:
    """trees x dim x (symbols * axes): the axes that each symbol of each tree looks along."""
    axes = min(dim, AXES)
    rng = np.random.default_rng(dim)
    return np.array([np.concatenate([np.linalg.qr(rng.standard_normal((dim, axes)))[0] for _ in range(SYMBOLS)], axis=1) for _ in range(trees)], np.float32)


def symbol_bits(dim: int) -> int:
    return max(1, (2 * min(dim, AXES) - 1).bit_length())


def leanings(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """rows x symbols x axes."""
    return (x @ rotation).reshape(len(x), SYMBOLS, -1)


def joined(symbols: np.ndarray, bits: int, ties: np.ndarray) -> np.ndarray:
    """Strings of symbols (last axis) as numbers; equal ones are ordered by `ties`, another way in each tree."""
    out = np.zeros(symbols.shape[:-1], np.int64)
    for i in range(symbols.shape[-1]):
        out = (out << bits) | symbols[..., i]
    return out << TIE_BITS | ties


def tie_order(ids: np.ndarray, tree: int) -> np.ndarray:
    return (scramble(ids.astype(np.uint64) ^ scramble(np.array([tree + 1], np.uint64))) >> U(64 - TIE_BITS)).astype(np.int64)


def strings(x: np.ndarray, rotation: np.ndarray, ties: np.ndarray) -> np.ndarray:
    lean = leanings(x, rotation)
    axis = np.abs(lean).argmax(axis=2)
    positive = np.take_along_axis(lean, axis[:, :, None], axis=2)[:, :, 0] > 0
    return joined(axis * 2 + positive, symbol_bits(x.shape[1]), ties)


def probe_strings(x: np.ndarray, rotation: np.ndarray, ties: np.ndarray, count: int, varied: int) -> np.ndarray:
    """rows x probes: a row's own string, then those that differ in the first `varied` symbols at the least
    cost, which is how far the row falls short of leaning that way."""
    lean = leanings(x, rotation)
    both = np.stack([-lean, lean], axis=3).reshape(len(x), SYMBOLS, -1)  # symbol = 2 * axis + sign
    cost = (both.max(axis=2, keepdims=True) - both) ** 2
    order = np.argsort(cost, axis=2, kind="stable")
    total, chosen = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1, 0), np.int64)
    for i in range(SYMBOLS):
        wide = order.shape[2] if i == 0 and varied == 1 else RIVALS if i < varied else 1
        rivals = order[:, i, :wide]
        sums = (total[:, :, None] + np.take_along_axis(cost[:, i], rivals, axis=1)[:, None, :]).reshape(len(x), -1)
        first = np.argsort(sums, axis=1, kind="stable")[:, :count]
        total = np.take_along_axis(sums, first, axis=1)
        before, now = first // rivals.shape[1], first % rivals.shape[1]
        chosen = np.concatenate([np.take_along_axis(chosen, before[:, :, None], axis=1), np.take_along_axis(rivals, now, axis=1)[:, :, None]], axis=2)
    return joined(chosen, symbol_bits(x.shape[1]), ties[:, None])


def coded(x: np.ndarray) -> list[bytes]:
    """Squared length and scale (32-bit), then two bytes for each component."""
    scale = np.abs(x).max(axis=1, initial=0)
    whole = np.rint(x / np.where(scale > 0, scale, 1)[:, None] * 32767).astype("<i2")
    head = np.column_stack([(x.astype(np.float64) ** 2).sum(axis=1), scale / 32767]).astype("<f4")
    return [h.tobytes() + w.tobytes() for h, w in zip(head, whole, strict=True)]


def decoded(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, and vectors."""
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return head[:, 0], np.ascontiguousarray(raw[:, 8:]).view("<i2").astype(np.float32) * head[:, 1:2]


def centred(x: np.ndarray, middles: dict[int, np.ndarray]) -> np.ndarray:
    """Lengths are cut so that no square overflows; that costs recall there, never a wrong distance."""
    return np.clip(x - middles.get(x.shape[1], 0.0), -1e15, 1e15).astype(np.float32)


def varied_symbols(rows: int, page: int, dim: int) -> int:
    """So many first symbols tell about as many strings apart as there are pages."""
    return min(SYMBOLS, max(1, math.ceil(math.log(max(2, rows / page), 2 * min(dim, AXES)))))


PLANT = "dim int, tree int, string long, id long, kind int, data binary"


def planted(rows: DataFrame, middles: dict[int, np.ndarray], trees: int, probes: dict[int, tuple[int, int]] | None) -> DataFrame:
    """PLANT: a row for each vector (vec_id, vector) and tree; with `probes` (strings and symbols to vary, by
    dimension) a row for each string that a query tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_dimension(batch, 1):
                dim = x.shape[1]
                if not dim:
                    continue
                x = centred(x, middles)
                ids, data = batch.column(0).take(pa.array(at)), pa.array(coded(x), pa.binary())
                for tree, rotation in enumerate(rotations(dim, trees)):
                    ties = tie_order(ids.to_numpy(), tree)
                    found = strings(x, rotation, ties)[:, None] if probes is None else probe_strings(x, rotation, ties, *probes[dim])
                    n = found.size
                    kind = np.zeros(found.shape, np.int32) if probes is None else np.broadcast_to(np.where(np.arange(found.shape[1]) == 0, OWN, PROBE), found.shape).astype(np.int32)
                    each = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(found.ravel()), ids.take(each), pa.array(kind.ravel()), data.take(each)], ["dim", "tree", "string", "id", "kind", "data"])

    return rows.select("vec_id", "vector").mapInArrow(run, PLANT)


def exact_sample(rows: DataFrame, sample: list[tuple[int, list]], k: int) -> DataFrame:
    """(query_id, vec_id): the `k` nearest other rows of each of the CHECK_QUERIES vectors in `sample`, among all rows."""
    asks = {}
    for vec_id, vector in sample:
        asks.setdefault(len(vector), []).append((vec_id, vector))
    matrices = {d: (np.array([i for i, _ in v], np.int64), np.array([x for _, x in v], np.float64)) for d, v in asks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for batch in batches:
            names = batch.column(0).to_numpy()
            for at, x in by_dimension(batch, 1):
                if x.shape[1] not in matrices:
                    continue
                who, q = matrices[x.shape[1]]
                away = np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in q])
                away[who[:, None] == names[at][None, :]] = np.inf
                first = np.argpartition(away, min(k, len(at)) - 1, axis=1)[:, :k]
                found = np.repeat(who, first.shape[1]), names[at][first].ravel(), np.take_along_axis(away, first, axis=1).ravel()
                best = first_of_each(*(np.concatenate(c) for c in zip(best, found, strict=True)), k, 1)
        seen = np.isfinite(best[2])
        yield pa.RecordBatch.from_arrays([pa.array(c[seen]) for c in best], ["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "vec_id")


def places(rows: DataFrame, middles: dict[int, np.ndarray], marks: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """For each (dimension, tree) and each of its sorted strings in `marks`, how many rows of that array stand before it."""
    trees = 1 + max((tree for _, tree in marks), default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {key: np.zeros(len(m) + 1, np.int64) for key, m in marks.items()}
        for batch in batches:
            for at, x in by_dimension(batch, 1):
                dim = x.shape[1]
                if (dim, 0) not in marks:
                    continue
                x, ids = centred(x, middles), batch.column(0).to_numpy()[at]
                for tree, rotation in enumerate(rotations(dim, trees)):
                    own = strings(x, rotation, tie_order(ids, tree))
                    total[dim, tree] += np.bincount(np.searchsorted(marks[dim, tree], own, side="right"), minlength=len(total[dim, tree]))
        for (dim, tree), counts in total.items():
            used = np.flatnonzero(counts[:-1])
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(used, pa.int64()), pa.array(counts[used])], ["dim", "tree", "mark", "n"])

    out = {key: np.zeros(len(m), np.int64) for key, m in marks.items()}
    counted = rows.select("vec_id", "vector").mapInArrow(run, "dim int, tree int, mark long, n long")
    for r in counted.groupBy("dim", "tree", "mark").agg(F.sum("n").alias("n")).collect():  # at most a row a mark
        out[r["dim"], r["tree"]][r["mark"]] = r["n"]
    return {key: np.cumsum(n) for key, n in out.items()}


def settings(rows: DataFrame, leaders: DataFrame, counts: dict[int, int], middles: dict[int, np.ndarray], trees: int, k: int) -> dict[int, tuple[int, int]]:
    """(strings, rows a page) for each dimension: the first of SETTINGS, which grow, that reads TARGET of the `k`
    nearest rows of CHECK_QUERIES queries (those with the least hashed ids), or the last of them.

    What comes to the driver is CHECK_QUERIES queries and k rows for each, and the places of their strings,
    for each dimension."""
    place = F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vec_id"), "vec_id"))
    sample = [(r["vec_id"], r["vector"]) for r in leaders.withColumn("place", place).where(F.col("place") <= CHECK_QUERIES).collect()]
    truth = exact_sample(rows, sample, k).collect()
    near = {r["vec_id"]: r["vector"] for r in rows.where(F.col("vec_id").isin(sorted({r["vec_id"] for r in truth}))).collect()} if truth else {}

    asked, sought, marks, chosen = {}, {}, {}, {}
    for dim in {len(v) for _, v in sample}:
        ids = np.array([i for i, v in sample if len(v) == dim])
        where = {i: n for n, i in enumerate(ids.tolist())}
        pairs = [(where[r["query_id"]], r["vec_id"]) for r in truth if r["query_id"] in where]
        if not pairs:
            continue
        q = centred(np.array([v for _, v in sample if len(v) == dim], float), middles)
        x = centred(np.array([near[i] for _, i in pairs], float), middles)
        for tree, rotation in enumerate(rotations(dim, trees)):
            ties = tie_order(ids, tree)
            asked[dim, tree] = {v: probe_strings(q, rotation, ties, PROBES, v) for v in {varied_symbols(counts[dim], page, dim) for _, page in SETTINGS}}
            sought[dim, tree] = strings(x, rotation, tie_order(np.array([i for _, i in pairs]), tree))
            marks[dim, tree] = np.unique(np.concatenate([sought[dim, tree], *(a.ravel() for a in asked[dim, tree].values())]))
        chosen[dim] = np.array([who for who, _ in pairs])
    before = places(rows, middles, marks)

    def share(dim: int, probes: int, page: int) -> float:
        """Of the rows sought, those in a page that is read."""
        hit = np.zeros(len(chosen[dim]), bool)
        last = max(1, counts[dim] // page) - 1
        for tree in range(trees):
            at = lambda s: np.minimum(before[dim, tree][np.searchsorted(marks[dim, tree], s)] // page, last)  # noqa: B023, E731
            tried = at(asked[dim, tree][varied_symbols(counts[dim], page, dim)][:, :probes])
            hit |= (tried[chosen[dim]] == at(sought[dim, tree])[:, None]).any(axis=1)
        return hit.mean()

    return {dim: next((s for s in SETTINGS if dim in chosen and share(dim, *s) >= TARGET), SETTINGS[-1] if dim in chosen else (PROBES, PAGE)) for dim in counts}


def pages_read(place: np.ndarray, own: np.ndarray, ask: np.ndarray, row: np.ndarray, pages: int, length: int = PAGE) -> tuple[np.ndarray, np.ndarray]:
    """(query, page) pairs: of each query the page at its place among the rows; at its own string also up to
    PROBES pages further, half of them on each side, while they share its prefix (ask and row: prefixes)."""
    page = np.minimum(place // length, pages - 1)
    who, which = [np.arange(len(place))], [page]
    for step in (1, -1):
        live = np.flatnonzero(own)
        for away in range(1, PROBES // 2 + 1):
            at = page[live] + step * away
            inside = (at >= 0) & (at < pages)
            edge = np.clip(at * length if step > 0 else at * length + length - 1, 0, len(row) - 1)
            live = live[inside & (row[edge] == ask[live])]
            if not len(live):
                break
            who.append(live)
            which.append(page[live] + step * away)
    return np.concatenate(who), np.concatenate(which)


def read_pages(string: np.ndarray, ids: np.ndarray, kind: np.ndarray, data: list[bytes], dim: int, usual: int, most: int, length: int) -> tuple[np.ndarray, ...]:
    """Of a stretch of one tree's array, queries among rows, for each query and page the `most` nearest rows by
    their codes: (query, row, squared distance). Prefixes longer than `usual` symbols count as dense."""
    rows, asks = np.flatnonzero(kind == ROW), np.flatnonzero(kind != ROW)
    if not len(rows) or not len(asks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    square, x = decoded([data[i] for i in rows])
    own_square, q = decoded([data[i] for i in asks])
    pages = max(1, len(rows) // length)  # the last is the longer for what is left
    prefix = string >> (TIE_BITS + max(0, SYMBOLS - usual - 1) * symbol_bits(dim))
    who, page = pages_read(np.searchsorted(rows, asks), kind[asks] == OWN, prefix[asks], prefix[rows], pages, length)
    _, fresh = np.unique(np.column_stack([page, ids[asks[who]]]), axis=0, return_index=True)  # in the order of pages
    who, page = who[fresh], page[fresh]
    borders = np.flatnonzero(np.r_[True, np.diff(page) > 0, True])
    out = []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        at = page[a]
        here = slice(at * length, len(rows) if at == pages - 1 else (at + 1) * length)
        step = max(1, CELLS // (here.stop - here.start))
        for mine in (who[i : min(i + step, b)] for i in range(a, b, step)):
            d2 = own_square[mine][:, None] + square[here][None, :] - 2 * q[mine] @ x[here].T
            first = np.argpartition(d2, min(most, d2.shape[1]) - 1, axis=1)[:, :most]
            out.append((np.repeat(ids[asks[mine]], first.shape[1]), ids[rows[here]][first].ravel(), np.take_along_axis(d2, first, axis=1).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search_arrays(plants: DataFrame, usual: dict[int, int], lengths: dict[int, int], most: int) -> DataFrame:
    """plants: PLANT, sorted -> (query_id, vec_id, about): for each task and query the `most` nearest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def best() -> tuple[np.ndarray, ...]:
            return first_of_each(*(np.concatenate(c) for c in zip(*held, strict=True)), most, 1)

        def stretches() -> Iterator[tuple[np.ndarray, ...]]:
            key, columns, data = (0, 0), [], []

            def read() -> tuple[np.ndarray, ...]:
                return read_pages(*(np.concatenate(c) for c in zip(*columns, strict=True)), data, key[0], usual.get(key[0], 1), most, lengths.get(key[0], PAGE))

            for batch in batches:
                dims, trees, *numbers = (batch.column(i).to_numpy() for i in range(5))
                cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (trees[1:] != trees[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                    here = (int(dims[a]), int(trees[a])) if b > a else key
                    if data and (key != here or len(data) >= BUFFER_ROWS):
                        yield read()
                        columns, data = [], []
                    key = here
                    columns.append([n[a:b] for n in numbers])
                    data += batch.column(5).slice(a, b - a).to_pylist()
            if data:
                yield read()

        for found in stretches():
            held.append(found)
            size += len(found[0])
            if size > HELD_ROWS:
                held = [best()]
                size = len(held[0][0])
                if size > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "vec_id", "about"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], ["query_id", "vec_id", "about"])

    return plants.mapInArrow(run, "query_id long, vec_id long, about float")


def distance(left: str, right: str):
    """Euclidean, in double precision, added up from the first component to the last."""
    gaps = F.zip_with(left, right, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x))


def nearest(vectors: DataFrame, query_where: str, k: int = 10, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score double): for each row of `vectors` (vec_id, vector) that satisfies
    `query_where` the `k` nearest other rows found, by Euclidean distance, ties to the smaller vec_id.

    A query reads at most 2 * trees * PROBES pages (twice as long at an array's end), whose length follows the
    recall of CHECK_QUERIES queries, to 16,384 rows. Hashes are centred on the mean of FIT_ROWS rows (those with the least hashed
    ids); all rows are indexed. Rows without vec_id and vectors without components take no part, of
    rows that share a vec_id the least vector counts, only vectors of the same dimension are compared;
    equal vectors are searched once for all of them. Other columns are not read, an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(one_each(vectors.select("vec_id", "vector")).where(F.size("vector") > 0), "vectors")
    counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()]  # FIT_ROWS rows
    middles = {d: np.clip(np.array([v for v in sample if len(v) == d], float), -1e15, 1e15).mean(axis=0) for d in {len(v) for v in sample}}

    asked = rows.where(query_where)
    asked = scratch.write(asked.withColumn("leader", F.min("vec_id").over(Window.partitionBy("vector"))), "asked")
    leaders = asked.where("vec_id = leader").select("vec_id", "vector")
    index = scratch.write(first_copies(rows, k + 1), "index")
    chosen = settings(index, leaders, counts, middles, trees, k)
    varied = {d: varied_symbols(n, chosen[d][1], d) for d, n in counts.items()}
    lengths = {d: page for d, (_, page) in chosen.items()}
    probes = {d: (tried, varied[d]) for d, (tried, _) in chosen.items()}
    plants = planted(index, middles, trees, None).unionByName(planted(leaders, middles, trees, probes))
    order = ["dim", "tree", "string", "kind", "id"]
    tasks = max(1, sum(counts.values()) * trees // TASK_ROWS)
    found = search_arrays(plants.repartitionByRange(tasks, *order).sortWithinPartitions(*order), varied, lengths, 2 * (k + 1))
    about = found.groupBy("query_id", "vec_id").agg(F.min("about").alias("about"))
    by_query = Window.partitionBy("query_id")
    near = about.withColumn("place", F.row_number().over(by_query.orderBy("about", "vec_id"))).where(F.col("place") <= KEPT * (k + 1)).select("query_id", "vec_id")

    pairs = scratch.write(near, "near").join(rows, "vec_id").join(leaders.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("own")), "query_id")
    exact = pairs.select("query_id", "vec_id", distance("own", "vector").alias("score"))
    best = exact.withColumn("rank", F.row_number().over(by_query.orderBy("score", "vec_id"))).where(F.col("rank") <= k + 1)
    each = asked.select(F.col("vec_id").alias("asker"), F.col("leader").alias("query_id")).join(best, "query_id").where("asker <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("asker").alias("query_id"), "rank", "vec_id", "score")

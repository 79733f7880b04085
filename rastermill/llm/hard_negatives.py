"""Hard negatives: rows of another label that score just below an anchor's positives.

Rows are filed under the nearest of some k-means centroids, which are fitted on a bounded sample; each list
keeps the radius of its rows about the centroid. By Cauchy-Schwarz no row of a list scores more than
<q, c> + |q| r with an anchor q, nor less than <q, c> - |q| r. An anchor visits lists by their upper bound, skips those
that lie outside its window of scores, and stops when the bound falls strictly below its k-th score.

Lists are packed into shards of about SHARD_ROWS rows, a large list into several. An anchor's vector goes
once to each shard that may have something for it; in a first round to one shard only, whose finds close most of
the others. Anchors are dealt into slabs, so that no task meets all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.llm.common import Scratch
from rastermill.llm.pivot_index import sort_key
from rastermill.llm.vectors import finite

SAMPLE_ROWS, MOST_CENTROIDS, STEPS = 20_000, 1024, 8
SHARD_ROWS, SLAB_ANCHORS = 16_384, 8_192
QUERY_BLOCK, ROW_BLOCK = 256, 2_048
EXACT = 2.0**53


def whole_vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector array<double>): floor(scale * x). Rows without id or label, with a null vector or a null
    or non-finite component take no part, nor do those with a component that isn't finite once scaled. Of
    rows that share a vec_id the least (vector, label) counts."""
    rows = df.where("vec_id IS NOT NULL AND label IS NOT NULL").where(finite(F.col("embedding")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", whole).alias("vector")).where(finite(F.col("vector")))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def fit_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """k-means from spread rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(STEPS):
        near = ((centroids**2).sum(axis=1)[None, :] - 2 * sample @ centroids.T).argmin(axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(near, minlength=count)
        np.add.at(sums, near, sample)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


class Lists:
    """What is known of the inverted lists, by dimension: centroids, radii, sizes, shards. At most MOST_CENTROIDS a
    dimension, whatever the number of rows."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids = centroids
        self.radius = {d: np.zeros(len(c)) for d, c in centroids.items()}
        self.rows = {d: np.zeros(len(c), np.int64) for d, c in centroids.items()}
        self.shards: dict[int, list[tuple[int, int]]] = {}

    def of(self, dim: int) -> np.ndarray:
        return self.centroids.get(dim, np.zeros((1, dim)))

    def deal(self) -> int:
        """Gives each list its shards (first, number); several small lists share one."""
        at = 0
        for dim, rows in self.rows.items():
            room, placed = 0, []
            for n in rows.tolist():
                parts = max(1, -(-n // SHARD_ROWS))
                if parts > 1 or n > room:
                    first, at = at, at + parts
                    room = SHARD_ROWS - n if parts == 1 else 0
                else:
                    first, room = at - 1, room - n
                placed.append((first, parts))
            self.shards[dim] = placed
        return at

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) that rows of each list can score with each row of x."""
        dim = x.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            middle = x @ self.of(dim).T
            length = np.linalg.norm(x, axis=1)[:, None]
            reach = length * self.radius[dim][None, :]
            slack = 1e-9 * (length * np.linalg.norm(self.of(dim), axis=1)[None, :] + reach) + 1e-6
            low, high = middle - reach - slack, middle + reach + slack
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def filed(rows: DataFrame, lists: Lists) -> DataFrame:
    """(dim, cluster, distance, vec_id, label, data)."""
    label = dict(rows.dtypes)["label"]

    def run(batches):
        for batch in batches:
            dims = batch["vector"].map(len)
            for dim, part in batch.groupby(dims, sort=False):
                x = np.stack(part["vector"].to_numpy()).astype(np.float64).reshape(len(part), int(dim))
                c = lists.of(int(dim))
                with np.errstate(over="ignore", invalid="ignore"):
                    near = np.nan_to_num((c**2).sum(axis=1)[None, :] - 2 * x @ c.T, nan=np.inf).argmin(axis=1)
                    distance = np.nan_to_num(np.linalg.norm(x - c[near], axis=1), nan=np.inf)
                yield pd.DataFrame({"dim": int(dim), "cluster": near, "distance": distance, "vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(), "data": [v.tobytes() for v in x]})

    return rows.mapInPandas(run, f"dim int, cluster int, distance double, vec_id long, label {label}, data binary")


def index(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, Lists, int]:
    """The filed rows with their shards, the lists, and the number of shards."""
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()  # SAMPLE_ROWS rows
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    wanted = min(MOST_CENTROIDS, math.ceil(count**0.5))
    with np.errstate(over="ignore", invalid="ignore"):
        lists = Lists({d: np.nan_to_num(fit_centroids(np.array(v, np.float64), min(wanted, len(v)))) for d, v in by_dim.items()})
    placed = scratch.write(filed(rows, lists), "filed")
    for r in placed.groupBy("dim", "cluster").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        dim = r["dim"]
        for table, kind in ((lists.radius, float), (lists.rows, np.int64)):
            table.setdefault(dim, np.zeros(len(lists.of(dim)), kind))
        lists.radius[dim][r["cluster"]], lists.rows[dim][r["cluster"]] = r["radius"], r["n"]
    shards = lists.deal()
    spark = rows.sparkSession
    table = spark.createDataFrame([(d, c, first, parts) for d, cells in lists.shards.items() for c, (first, parts) in enumerate(cells)], "dim int, cluster int, first int, parts int")
    dealt = placed.join(F.broadcast(table), ["dim", "cluster"])  # a row for each list
    dealt = dealt.select("dim", "cluster", "vec_id", "label", "data", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"))
    return dealt, lists, shards


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: as doubles where all sums stay below 2**53, else as Python integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < EXACT:
        return q @ x.T
    big = np.frompyfunc(int, 1, 1)
    return big(q) @ big(x).T


def requests(asked: DataFrame, lists: Lists, first_round: bool) -> DataFrame:
    """asked: (dim, vec_id, label, data, lows, highs, least): for each window its bounds (null: none) and the k-th score
    so far (null: fewer), as text. Adds `shard`: the shard of the most promising list in the first round, and in the second
    all others that may have something."""
    label, names = dict(asked.dtypes)["label"], [*asked.columns, "shard"]

    def run(batches):
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=False):
                x = np.stack([np.frombuffer(d, np.float64) for d in part["data"]])
                low, high = lists.bounds(x)
                cells = lists.shards[int(dim)]
                filled = lists.rows[int(dim)] > 0
                out: dict[str, list] = {"at": [], "shard": []}
                for i, (lows, highs, least) in enumerate(zip(part["lows"], part["highs"], part["least"], strict=True)):
                    open_ = np.zeros(len(cells), bool)
                    for a, b, s in zip(lows, highs, least, strict=True):
                        a, b, s = (float(v) if v is not None else d for v, d in ((a, -np.inf), (b, np.inf), (s, -np.inf)))
                        open_ |= (high[i] >= max(a, s)) & (low[i] <= b)
                    open_ &= filled
                    if not open_.any():
                        continue
                    best = cells[int(np.where(filled, high[i], -np.inf).argmax())][0]
                    wanted = {best} if first_round else {f + k for c in np.flatnonzero(open_).tolist() for f, n in [cells[c]] for k in range(n)} - {best}
                    out["at"] += [i] * len(wanted)
                    out["shard"] += sorted(wanted)
                if out["at"]:
                    chosen = part.iloc[out["at"]]
                    yield chosen.assign(shard=out["shard"])[names]

    return asked.mapInPandas(run, f"dim int, vec_id long, label {label}, data binary, lows array<string>, highs array<string>, least array<string>, shard int")


def search(dealt: DataFrame, asked: DataFrame, lists: Lists, slabs: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, vec_id, score, key): for each shard that an anchor asks the first `k` rows of each of its
    windows, of its own label (`same`) or of others."""
    slab = F.pmod(F.xxhash64("vec_id"), F.lit(slabs)).cast("int")
    copies = dealt.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in anchors.groupby("dim", sort=False) if len(anchors) and len(rows) else []:
            mine = rows[rows["dim"] == dim].sort_values(["cluster", "vec_id"])
            if len(mine):
                out += visit(mine, part, lists, same, k)
        found = pd.DataFrame(out, columns=["anchor_id", "window", "vec_id", "score"])
        return found.assign(score=found["score"].map(str), key=found["score"].map(sort_key))

    asked = asked.withColumn("slab", slab)
    return copies.groupBy("shard", "slab").cogroup(asked.groupBy("shard", "slab")).applyInPandas(run, "anchor_id long, window int, vec_id long, score string, key binary")


def visit(rows: pd.DataFrame, anchors: pd.DataFrame, lists: Lists, same: bool, k: int) -> list[tuple[int, int, int, int]]:
    """Anchors, in blocks, visit the lists of a shard: in each round every anchor its best list that is left, unless its
    bounds lie outside all windows or below their k-th scores."""
    cluster, ids = rows["cluster"].to_numpy(), rows["vec_id"].to_numpy()
    x = np.stack([np.frombuffer(d, np.float64) for d in rows["data"]])
    codes, _ = pd.factorize(pd.concat([rows["label"], anchors["label"]]), use_na_sentinel=False)
    label, own = codes[: len(rows)], codes[len(rows) :]
    here = np.unique(cluster)
    begins, ends = np.searchsorted(cluster, here), np.searchsorted(cluster, here, side="right")
    out = []
    for begin in range(0, len(anchors), QUERY_BLOCK):
        some = anchors.iloc[begin : begin + QUERY_BLOCK]
        q, who, mark = np.stack([np.frombuffer(d, np.float64) for d in some["data"]]), some["vec_id"].to_numpy(), own[begin : begin + QUERY_BLOCK]
        least, most = (b[:, here] for b in lists.bounds(q))
        windows = [Windows(*w, k) for w in zip(some["lows"], some["highs"], some["least"], strict=True)]
        # As doubles, rounded outwards; the windows themselves decide by whole numbers.
        foot, top = np.array([w.foot for w in windows]), np.array([w.top for w in windows])
        order, each = np.argsort(-most, axis=1, kind="stable"), np.arange(len(some))
        for step in range(len(here)):
            c = order[:, step]
            due = np.flatnonzero((most[each, c] >= foot) & (least[each, c] <= top))
            for which in np.unique(c[due]).tolist():
                asking = due[c[due] == which]
                for at in range(int(begins[which]), int(ends[which]), ROW_BLOCK):
                    until = min(at + ROW_BLOCK, int(ends[which]))
                    scores = products(q[asking], x[at:until])
                    right = (label[at:until][None, :] == mark[asking][:, None]) == same
                    right &= ids[at:until][None, :] != who[asking][:, None]
                    right &= ((scores >= foot[asking][:, None]) & (scores <= top[asking][:, None])).astype(bool)
                    for j in np.flatnonzero(right.any(axis=1)).tolist():
                        i, hit = asking[j], np.flatnonzero(right[j])
                        windows[i].take(scores[j][hit], ids[at:until][hit])
                        foot[i] = windows[i].foot
        out += [(int(who[i]), w, vec, -negative) for i, each_ in enumerate(windows) for w, kept in enumerate(each_.found) for negative, vec in kept]
    return out


class Windows:
    """The windows of one anchor, bounds given as text (null: none), and the `k` best scores of each."""

    def __init__(self, lows, highs, least, k: int):
        number = lambda v: None if v is None else int(v)
        self.bounds = [(max((number(v) for v in (low, before) if v is not None), default=None), number(high)) for low, high, before in zip(lows, highs, least, strict=True)]
        self.k, self.found = k, [[] for _ in self.bounds]
        self.top = max((np.inf if high is None else np.nextafter(float(high), np.inf) for _, high in self.bounds), default=-np.inf)
        self.note()

    def note(self) -> None:
        """What a score must reach to be of use to any window."""
        feet = []
        for (low, _), kept in zip(self.bounds, self.found, strict=True):
            foot = max((v for v in (low, -kept[-1][0] if len(kept) == self.k else None) if v is not None), default=None)
            feet.append(-np.inf if foot is None else np.nextafter(float(foot), -np.inf))
        self.foot = min(feet, default=np.inf)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype != object:
            order = np.lexsort((ids, -scores))
            scores, ids = scores[order], ids[order]
        for w, (low, high) in enumerate(self.bounds):
            good = np.ones(len(scores), bool)
            if low is not None:
                good &= (scores >= low).astype(bool)
            if high is not None:
                good &= (scores <= high).astype(bool)
            hit = np.flatnonzero(good)
            if scores.dtype != object:
                hit = hit[: self.k]
            self.found[w] = sorted([*self.found[w], *((-int(scores[h]), int(ids[h])) for h in hit.tolist())])[: self.k]
        self.note()


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The `k` first rows of each anchor and window, with their rank."""
    w = Window.partitionBy("anchor_id", "window").orderBy(F.col("key").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def two_rounds(dealt: DataFrame, asked: DataFrame, lists: Lists, shards: int, slabs: int, same: bool, k: int, scratch: Scratch, name: str) -> DataFrame:
    """All windows' first `k` rows: from the best shard, then from those that its finds don't close."""
    probe = scratch.write(first_of(search(dealt, requests(asked, lists, True), lists, slabs, same, k), k), f"{name}-probe")
    if shards == 1:
        return probe
    size = F.size("lows")
    reached = probe.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
    again = asked.join(reached.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
    again = again.withColumn("least", F.when(F.col("known").isNull(), F.col("least")).otherwise(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at("known", i))))
    more = search(dealt, requests(again.select(asked.columns), lists, False), lists, slabs, same, k)
    return scratch.write(first_of(more.unionByName(probe.drop("rank")), k), f"{name}-found")


def windows_of(positives: DataFrame, low_percent: int, high_percent: int) -> DataFrame:
    """(anchor_id, place, positive_id, positive_score, low, high): the least and largest score that a negative of each
    positive may have; none for scores below zero."""

    def run(batches):
        for batch in batches:
            score = batch["score"].map(int)
            some = batch[score >= 0]
            score = score[score >= 0]
            low, high = (score.map(f).astype(str) for f in (lambda s: -(-low_percent * s // 100), lambda s: high_percent * s // 100))
            yield pd.DataFrame({"anchor_id": some["anchor_id"], "place": some["rank"] - 1, "positive_id": some["vec_id"], "positive_score": some["score"], "low": low, "high": high})

    return positives.select("anchor_id", "rank", "vec_id", "score").mapInPandas(run, "anchor_id long, place int, positive_id long, positive_score string, low string, high string")


def hard_negatives(rows: DataFrame, anchor_where: str, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row of `rows` (vec_id, label,
    vector of whole numbers) that satisfies `anchor_where` and each of its `positives` best rows of the same label
    the first `negatives` rows of other labels whose score lies between `low_percent` and `high_percent`
    of the positive's.

    Scores are exact inner products, higher ones first, ties to the smaller vec_id; a score beyond 64 bits is null in
    the result but ranks as what it is. Only vectors of one dimension are compared; an anchor never finds itself.
    Fewer rows give fewer results; a positive without a negative gives none, nor does one of a score below
    zero, whose window is empty. An empty table gives no rows; other columns are not read. vec_id must name one row,
    as whole_vectors() sees to. Rows of one label with equal vectors are searched once for each of their first
    copies, more of which can't rank.

    The centroids are fitted on the SAMPLE_ROWS rows with the least hashed ids; all rows are filed and searched.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    most = max(positives, negatives) + 1
    whole = scratch.write(rows.select("vec_id", "label", "vector"), "vectors")
    copies = Window.partitionBy("vector", "label").orderBy("vec_id")
    kept = whole.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= most).drop("_copy")
    dealt, lists, shards = index(scratch.write(kept, "kept"), scratch)
    dealt = scratch.write(dealt, "dealt")
    scratch.drop("filed")
    anchors = filed(whole.where(anchor_where), lists).select("dim", "vec_id", "label", "data")
    slabs = max(1, -(-whole.where(anchor_where).count() // SLAB_ANCHORS))
    nothing = F.array(F.lit(None).cast("string"))
    asked = scratch.write(anchors.select("*", nothing.alias("lows"), nothing.alias("highs"), nothing.alias("least")), "anchors")
    if shards == 0:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    best = two_rounds(dealt, asked, lists, shards, slabs, True, positives, scratch, "positives")
    bounds = windows_of(best, low_percent, high_percent)
    bounds = scratch.write(bounds, "bounds")
    order = F.array_sort(F.collect_list(F.struct("place", "low", "high", "positive_id", "positive_score")))
    windows = bounds.groupBy(F.col("anchor_id").alias("vec_id")).agg(order.alias("w"))
    wanted = asked.drop("lows", "highs", "least").join(windows, "vec_id")
    wanted = wanted.select("dim", "vec_id", "label", "data", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.transform("w", lambda _: F.lit(None).cast("string")).alias("least"), F.col("w.positive_id").alias("positive_ids"), F.col("w.positive_score").alias("positive_scores"))
    wanted = scratch.write(wanted, "wanted")
    found = two_rounds(dealt, wanted.drop("positive_ids", "positive_scores"), lists, shards, slabs, False, negatives, scratch, "negatives")
    named = found.join(wanted.select(F.col("vec_id").alias("anchor_id"), "positive_ids", "positive_scores"), "anchor_id")
    number = lambda c: c.try_cast("long")
    return named.select("anchor_id", F.get("positive_ids", F.col("window")).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), number(F.get("positive_scores", F.col("window"))).alias("positive_score"), number(F.col("score")).alias("negative_score"))

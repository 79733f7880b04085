"""Best-first partition trees under a budget.

A tree is searched where its image's prefix sums are: jobs (an image and a variant) are dealt out in parts, and
each of a tree's few hundred nodes is split by arrays in that task (see splits). taken_splits() is the
search alone, over nodes that are given as rows.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.functions import columns as C
from rastermill.functions import constants as K
from rastermill.operators.deal import dealt, in_lots, tasks
from rastermill.operators.decode import cut
from rastermill.operators.splits import SUMS, ImageScorer

TREE = ["image_id", "variant_id"]
KEYS = [*TREE, "node"]
VARIANTS_A_PART = 64
LOT_WORK = 1 << 15
TREES_A_TURN = 1_000


def scratch(spark: SparkSession) -> str:
    """A new folder where the cluster shares files; a temporary one only where none is set and Spark is one
    local process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-rastermill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/trees-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def coding_jobs(images: DataFrame, variants: DataFrame, target_size: int) -> DataFrame:
    """A row for each image (width, height) and variant, with what its tree needs."""
    jobs = images.join(F.broadcast(variants.withColumn("_one", F.lit(1))), F.col("_one") == 1).drop("_one")  # at most 31,500 variants
    tax = C.image_tax(F.col("width"), F.col("height"))
    return jobs.select(
        *TREE, "width", "height", "partition_code", "color_options", (F.col("line_limit") + 1).alias("line_limit"), F.lit(target_size).alias("target_size"), tax.alias("tax"),
        C.level_scale(F.col("width"), F.col("height"), F.col("partition_code")).alias("scale"), C.angle_bits(F.col("partition_code")).alias("bits"), (8 * target_size - 1 - tax).alias("budget"), F.lit(None).cast("double").alias("bound"),
    )


class PairingHeap:
    """Items by score, the best first. Which of equal scores comes first is part of the format's result: an item keeps
    those it has beaten, the latest first; when it goes they are paired from that end, and the pairs joined from
    the last to the first; of equals the one that is named first stays on top."""

    def __init__(self):
        self.top: tuple[float, object, list] | None = None

    @staticmethod
    def joined(a, b):
        if a is None or b is None:
            return a or b
        if a[0] < b[0]:
            a, b = b, a
        a[2].append(b)
        return a

    def push(self, score: float, item) -> None:
        self.top = self.joined(self.top, (score, item, []))

    def pop(self) -> tuple[float, object]:
        score, item, beaten = self.top
        beaten.reverse()
        pairs = [self.joined(beaten[i], beaten[i + 1] if i + 1 < len(beaten) else None) for i in range(0, len(beaten), 2)]
        self.top = None
        for pair in reversed(pairs):
            self.top = self.joined(pair, self.top)
        return score, item


# What a node that can't be split counts in the heap.
UNSPLIT = -1.0


class Outlook:
    """What the colour codes of a job can still pay for while its tree grows, and the least error that each may end with.

    A code takes splits in the order of the tree until it can't pay for one. Of the leaves that there are then, a plain code's
    error is known. Before, a code that can pay for m more splits at most may still better m leaves, each by no more than
    what its pixels differ from their mean and its colour from what is shown for it; other leaves stay as they
    are. What a palette loses against the leaves' own colours counts as nothing.
    """

    def __init__(self, job):
        codes = np.array([c for c in range(K.COLOR_CODES) if int(job.color_options) >> c & 1])
        plain = codes < K.FIRST_PALETTE_CODE
        self.codes, self.steps = codes, np.where(plain, (4 + (codes & 3) << (np.minimum(codes, 16) >> 2)), 0)
        palette = np.maximum(codes - K.FIRST_PALETTE_CODE + 1, 0)
        self.tax = 1 + np.where(plain, 3 * np.log2(self.steps + 1), np.log2(np.maximum(palette, 1)))
        self.left = 8 * job.target_size - 4 - job.tax - 24 * palette - self.tax
        self.least_cost = 1 + min(job.bits) + self.tax
        self.open = np.ones(len(codes), bool)
        self.error = np.full(len(codes), -np.inf)  # once a code has ended
        self.taken = np.zeros(len(codes), int)

    def take(self, cost: float, leaves: dict) -> None:
        """A split of that cost is due, before it is done."""
        ends = self.open & (self.left < cost + self.tax - MARGIN)
        if ends.any():
            self.error[ends] = np.where(self.taken[ends] > 1, self.least(leaves, ends, 0), np.inf)
            self.open &= ~ends
        self.left = self.left - np.where(self.open, cost + self.tax, 0)
        self.taken += self.open

    def least(self, leaves: dict, which: np.ndarray, more: np.ndarray | int) -> np.ndarray:
        """The least errors of some codes, with `more` splits to come."""
        rows = np.array(list(leaves.values()), np.float64)
        means, count, rest, splits = rows[:, :3], rows[:, 3], rows[:, 4], rows[:, 5] > 0
        steps = np.maximum(self.steps[which], 1).astype(np.float32)[:, None, None]
        shown = np.floor(np.trunc(means.astype(np.float32) * (steps / np.float32(255)) + np.float32(0.5)) * (np.float32(255) / steps)).astype(float)  # as shown_colors()
        missed = np.where(self.steps[which][:, None] > 0, ((shown - means) ** 2).sum(axis=2) * count, 0)
        gain = -np.sort(-np.where(splits, rest + missed, 0), axis=1).cumsum(axis=1)
        kept = missed.sum(axis=1) - ((means**2).sum(axis=1) * count).sum()
        most = np.broadcast_to(np.minimum(more, len(rows)), (len(kept),))
        return kept - np.where(most > 0, np.take_along_axis(gain, np.maximum(most - 1, 0)[:, None], axis=1)[:, 0], 0)

    def errors(self, leaves: dict) -> np.ndarray:
        """The least error of each code."""
        if self.open.any():
            more = np.maximum(np.floor(self.left / self.least_cost + MARGIN), 0).astype(int)
            self.error[self.open] = self.least(leaves, self.open, more[self.open])
        return self.error

    def close(self, leaves: dict) -> None:
        """No split is left."""
        self.error[self.open] = np.where(self.taken[self.open] > 1, self.least(leaves, self.open, 0), np.inf) if self.open.any() else 0
        self.open[:] = False

    def options(self, bound: float) -> int:
        """The colour codes that may reach an error of `bound` or less, as a set of bits."""
        return sum(1 << int(c) for c in self.codes[self.error <= bound + BOUND_MARGIN * (1 + abs(bound))])


# Sums are rounded otherwise here than where trials are counted; a code or a job goes only where that can't matter.
MARGIN, BOUND_MARGIN = 1e-6, 1e-6
LOOK_EVERY = 4


class Tree:
    """The search of one job: nodes as rows of NODE, in the order in which they are met. It ends when no colour code can
    pay for another split, or when none can reach the job's `bound`; `options` are then the codes that may."""

    def __init__(self, scorer: ImageScorer, job):
        self.scorer, self.job, self.rows, self.parts, self.leaves = scorer, job, [], [], {}
        bound = job.bound if job.bound == job.bound and job.bound is not None else np.inf
        look = Outlook(job)
        y = np.arange(job.height)
        budget, heap, taken = np.float32(job.budget), PairingHeap(), 0
        self.meet("", np.column_stack([y, np.zeros_like(y), np.full_like(y, job.width)]), heap)
        while heap.top:
            score, at = heap.pop()
            if score < 0:
                break  # no other can be split either
            cost = np.float32(1 + self.rows[at][-2])
            if cost > budget:
                continue  # too dear: it is dropped, not the search
            look.take(float(self.rows[at][-2]), self.leaves)
            if not look.open.any():
                break
            budget -= cost
            self.rows[at][-1] = taken
            taken += 1
            del self.leaves[at]
            for side, part in zip("LR", self.parts[at], strict=True):
                self.meet(self.rows[at][0] + side, part, heap)
            if taken % LOOK_EVERY == 0 and bound < np.inf and not self.may(look, bound):
                break
        else:
            look.close(self.leaves)
        self.options = look.options(bound) if bound < np.inf else int(job.color_options)

    def may(self, look: Outlook, bound: float) -> bool:
        look.errors(self.leaves)
        return look.options(bound) > 0

    def meet(self, name: str, spans: np.ndarray, heap: PairingHeap) -> None:
        """Adds a node, also to the heap."""
        dx, dy = int(spans[:, 2].max() - spans[:, 1].min()), int(np.ptp(spans[:, 0])) + 1
        level = next((i for i, s in enumerate(self.job.scale) if dx * dx + dy * dy >= s), len(self.job.scale) - 1)
        bits = int(self.job.bits[level])
        *sums, score, code, line, sn, cs, d, lines = self.scorer.best(spans, bits, int(self.job.line_limit))
        cost, parts = None, ()
        if score is not None:
            parts = cut(spans, sn, cs, d)
            if all(map(len, parts)):
                cost = 1 + bits + math.log2(lines)
        if cost is None:
            score = code = line = lines = None
        heap.push(UNSPLIT if score is None else score, len(self.rows))
        means = [x / sums[3] for x in sums[:3]]
        self.leaves[len(self.rows)] = (*means, sums[3], self.scorer.squares(spans) - sum(m * x for m, x in zip(means, sums, strict=False)), cost is not None)
        self.parts.append(parts)
        self.rows.append([name, *sums, bits, score, code, line, lines, cost, None])


def replay(names: list[str], scores: list[float], costs: list[np.float32], budget: np.float32) -> list[str]:
    """The splits of one tree in the order in which they are taken; costs with the bit that says that a node is split."""
    known = dict(zip(names, zip(scores, costs, strict=True), strict=True))
    taken, heap = [], PairingHeap()
    if "" in known:
        heap.push(known[""][0], "")
    while heap.top:
        score, node = heap.pop()
        if score < 0:
            break
        cost = known[node][1]
        if cost > budget:
            continue
        budget -= cost
        taken.append(node)
        for child in (node + "L", node + "R"):
            if child in known:
                heap.push(known[child][0], child)
    return taken


def taken_splits(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(image_id, variant_id, node, ordinal): splits in the order in which the best affordable one is
    taken, equal scores in the order of PairingHeap; one that is too dear is dropped, not the search. A tree
    has a few hundred nodes, those that can't be split with a null score; it is a row, and a task takes many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), TREES_A_TURN):
                part = batch.slice(begin, TREES_A_TURN)
                trees = part.column("nodes")
                ends, rows = np.concatenate([[0], np.cumsum(trees.value_lengths().to_numpy(zero_copy_only=False))]).tolist(), trees.flatten()
                names = rows.field("node").to_pylist()
                scores, costs = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("score", "cost"))  # null: NaN
                scores = np.where(np.isnan(scores) | np.isnan(costs), UNSPLIT, scores).tolist()
                costs, budgets = list((1 + costs).astype(np.float32)), part.column("budget").to_numpy(zero_copy_only=False).astype(np.float32)
                taken = [replay(names[a:b], scores[a:b], costs[a:b], budget) for a, b, budget in zip(ends, ends[1:], budgets, strict=False)]
                counts = [len(t) for t in taken]
                of = pa.array(np.repeat(np.arange(len(part)), counts))
                ordinals = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
                yield pa.RecordBatch.from_arrays([part.column("image_id").take(of), part.column("variant_id").take(of), pa.array([n for t in taken for n in t], pa.string()), pa.array(ordinals)], names=[*KEYS, "ordinal"])

    trees = nodes.groupBy(*TREE).agg(F.collect_list(F.struct("node", F.col("score").cast("double").alias("score"), F.col("cost").cast("double").alias("cost"))).alias("nodes"))
    rows = trees.join(jobs.select(*TREE, F.col("budget").cast("double").alias("budget")), TREE)
    return rows.select(F.col("image_id").cast("long").alias("image_id"), F.col("variant_id").cast("int").alias("variant_id"), "nodes", "budget").mapInArrow(run, "image_id long, variant_id int, node string, ordinal int")


def build_trees(jobs: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """The nodes that are met for each job, written to `at`; `ordinal` is the turn of those that are split, `options` the
    colour codes that may reach the job's bound. A job none of whose codes may has no nodes. `rows`: prefix_rows().

    Parts of small images share a lot: a group of LOT_WORK pixels, each counted once a job, or of less where there are fewer lots
    than tasks; larger parts are lots of their own. A lot gets the rows of each of its parts' images once."""
    jobs = jobs.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("image_id").orderBy("line_limit", "partition_code", "variant_id")) - 1) / VARIANTS_A_PART))
    parts = jobs.groupBy("image_id", "_part").agg(F.sum(F.col("width") * F.col("height")).alias("_work"))
    parts = in_lots(parts, ["image_id", "_part"], LOT_WORK, tasks(jobs.sparkSession))
    copies = rows.join(parts, "image_id").select(F.col("image_id").alias("_image"), F.col("_part").alias("_piece"), F.col("_lot").alias("_group"), "y", *SUMS[:3])
    names = [*KEYS, *SUMS, "angle_bits", "score", "angle_code", "line", "num_lines", "cost", "ordinal", "options"]

    def run(some: pd.DataFrame, image: pd.DataFrame) -> pd.DataFrame:
        images, out = dict(iter(image.groupby(["_image", "_piece"], sort=False))), []
        for key, each in some.groupby(["image_id", "_part"], sort=False):
            scorer = ImageScorer(images.pop(key), exact=False)
            for job in each.itertuples():
                tree = Tree(scorer, job)
                if tree.options:
                    out += [[job.image_id, job.variant_id, *row, tree.options] for row in tree.rows]
        whole = {n: "Int64" for n in (*SUMS, "angle_bits", "angle_code", "line", "num_lines", "ordinal", "options")}
        return pd.DataFrame(out, columns=names).astype(whole | {"score": "Float64", "cost": "Float64"})

    schema = "image_id long, variant_id int, node string, sr long, sg long, sb long, c long, angle_bits long, score double, angle_code int, line long, num_lines long, cost double, ordinal int, options long"
    wanted = jobs.join(parts, ["image_id", "_part"]).select(*TREE, "scale", "bits", "width", "height", "partition_code", "line_limit", "color_options", "target_size", "tax", "budget", "bound", "_part", "_lot")
    return stored(dealt(wanted, "_lot").groupBy("_lot").cogroup(dealt(copies, "_group").groupBy("_group")).applyInPandas(run, schema), at)


def budget_prefix(costs: DataFrame, keys: list[str]) -> DataFrame:
    """costs (keys, ordinal, cost, budget) -> (keys, n): how many splits are affordable in order,
    stopping at the first that isn't."""
    w = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return costs.withColumn("spent", F.sum("cost").over(w)).groupBy(*keys).agg(F.sum(F.when(F.col("spent") <= F.col("budget"), 1).otherwise(0)).alias("n"))

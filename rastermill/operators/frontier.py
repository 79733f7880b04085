"""Best-first trees of large images: each round splits a whole frontier of regions as rows.

No task holds a tree's regions. After each round the search is replayed over the scores known so far; the regions that it would
meet next are the next frontier, and it is over when it needs no region that has not been scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions import columns as C
from rastermill.operators import geometry as G
from rastermill.operators import splits as S
from rastermill.operators.tree import KEYS, TREE, scratch, stored, taken_splits

NODE = [*KEYS, *S.SUMS, "angle_bits", "score", "angle_code", "line", "num_lines", "cost"]


def with_bits(spans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds angle_bits, by the size of each region, and line_limit."""
    sizes = G.squared_size(spans, KEYS).join(jobs.select(*TREE, "scale", "bits", "line_limit"), TREE)
    level = C.level_of(F.col("size"), F.col("scale"))
    sizes = sizes.select(*KEYS, F.get("bits", level.cast("int")).cast("int").alias("angle_bits"), F.col("line_limit").cast("int").alias("line_limit"))
    return spans.join(sizes, KEYS)


def halves(node):
    return F.explode(F.array(F.concat(node, F.lit("L")), F.concat(node, F.lit("R"))))


def frontier_trees(jobs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, taken) of the trees of `jobs` (see coding_jobs), as Tree grows them under the whole budget. `rows`: the images'
    prefix sums by prefix_rows(). Nodes are the root and both parts of all that is split."""
    at = scratch(jobs.sparkSession)
    jobs = stored(jobs, f"{at}/jobs")
    spans = G.root_spans(jobs.select(*TREE, "width", "height")).select(*TREE, F.lit("").alias("node"), "y", "x0", "x1")
    nodes = parts = None
    turn = 0
    while True:
        spans = stored(with_bits(spans, jobs), f"{at}/spans-{turn}")
        scored = stored(S.scored_regions(spans, rows, KEYS, lots=True), f"{at}/scored-{turn}")
        cuts = spans.join(scored.where("score IS NOT NULL").select(*KEYS, "sn", "cs", "d"), KEYS)
        pieces = stored(G.split_spans(cuts.select(*KEYS, "y", "x0", "x1", "sn", "cs", "d")).select(*KEYS, "side", "y", "x0", "x1"), f"{at}/pieces-{turn}")
        whole = pieces.groupBy(*KEYS).agg((F.count_distinct("side") == 2).alias("whole")).where("whole")  # both sides have pixels
        met = scored.join(spans.select(*KEYS, "angle_bits").distinct(), KEYS).join(whole, KEYS, "left")
        split = lambda c: F.when(F.col("whole"), F.col(c)).alias(c)
        cost = F.when(F.col("whole"), 1 + F.col("angle_bits") + F.log2(F.col("num_lines").cast("double"))).alias("cost")
        met = met.select(*KEYS, *S.SUMS, "angle_bits", *map(split, ("score", "angle_code", "line", "num_lines")), cost)
        nodes = stored(met if nodes is None else nodes.unionByName(met), f"{at}/nodes-{turn}")  # all so far, for plans to stay short
        below = pieces.join(whole.drop("whole"), KEYS).select(*TREE, F.concat("node", "side").alias("node"), "y", "x0", "x1")
        parts = stored(below if parts is None else parts.unionByName(below), f"{at}/parts-{turn}")
        taken = stored(taken_splits(nodes, jobs), f"{at}/taken-{turn}")
        needed = stored(taken.select(*TREE, halves(F.col("node")).alias("node")).join(nodes.select(*KEYS), KEYS, "left_anti"), f"{at}/needed-{turn}")
        if needed.isEmpty():
            used = taken.select(*TREE, halves(F.col("node")).alias("node")).unionByName(jobs.select(*TREE, F.lit("").alias("node")))
            return nodes.join(used, KEYS, "left_semi").select(*NODE), taken
        spans, parts = parts.join(needed, KEYS, "left_semi"), parts.join(needed, KEYS, "left_anti")
        turn += 1

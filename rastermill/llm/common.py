"""What several operators share: scratch tables in the cluster's shared folder, text
digests, running sums that survive a hot group, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and Spark is one local process (a test)
    a new one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-rastermill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and about `size` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        until = int(np.searchsorted(ends, ends[at] - sizes[at] + size, side="right"))
        until = min(max(at + 1, until), at + rows)
        yield batch.slice(at, until - at)
        at = until


def text_digest(text: Column) -> Column:
    """128 bits that stand for a text (null counts as empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def running_start(df: DataFrame, keys: list[str], spread: str, order: list[str], value: str, out: str, chunks: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `keys` that stand before this one.

    `spread` holds numbers in [0, 1), evenly spread, and is the first sort column. A group is
    dealt into `chunks` ranges of it, so that no window holds more than a range; the sums
    of the ranges are added from a table of `chunks` rows a group. `order` breaks ties.
    """
    if chunks <= 1:
        w = Window.partitionBy(*keys).orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    dealt = df.withColumn("_chunk", F.floor(F.col(spread) * chunks).cast("int"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_inner", F.coalesce(F.sum(value).over(w), F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return inner.join(sums, [*keys, "_chunk"]).withColumn(out, F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_chunk")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (u, v), for each node of an edge.

    Rounds of two steps, each written to the shared folder: every node links its larger neighbours to the
    smallest of its neighbours and itself, then its smaller ones likewise. That keeps components and turns
    each into a star about its smallest node; rounds grow with the logarithm of a chain's length. Partial
    minima are taken before rows are dealt out, and the joins are such as Spark splits at a hot node.
    """

    def stars(links: DataFrame) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()

    def state(links: DataFrame) -> tuple:
        marks = [F.sum(F.shiftright(F.xxhash64(*pair), 20)) for pair in (("u", "v"), ("v", "u"))]
        return tuple(links.agg(F.count(F.lit(1)), *marks).first())

    high, low = F.greatest("u", "v"), F.least("u", "v")
    links = scratch.write(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), f"{name}-0")
    last, i = state(links), 0
    while True:
        i += 1
        links = scratch.write(stars(links), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = state(links)
        if now == last:
            heads = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
        last = now

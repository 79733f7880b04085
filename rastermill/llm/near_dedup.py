"""Near-duplicate documents by order-preserving min-hash and banded alignment.

Each document is a sequence of five-word shingles, every one labelled with how often it
occurred before. A sketch is the few shingles that are smallest under one hash function, in
text order, so it survives edits but not reordering. Texts that share a sketch are candidates;
they are gathered into cells and verified by an alignment within the band that the threshold
allows. In a large cell all texts meet first those that share most sketches, then the first
texts of the classes found so far meet each other; only texts outside a cell's largest class
then meet all others.
Classes are the connected components of verified links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rastermill.llm.common import Scratch, connected_components, slices, text_digest
from rastermill.llm.shingles import U, labelled_shingles, scramble, word_hashes

WIDTH, SIMILARITY, SKETCHES, DRAWN = 5, 0.8, 12, 2
SLICE, BLOCK, HUBS, WHOLE_CELL = 64, 256, 64, 4096
KEPT_ID, KEPT_TEXT = "_rastermill_id", "_rastermill_text"


def sketches(shingles: np.ndarray, count: int, drawn: int) -> np.ndarray:
    """`count` hashes, each of the `drawn` shingles that are least under its function, in text order."""
    seeds = scramble(np.arange(1, count + 1, dtype=np.uint64))[:, None]
    mixed = (shingles[None, :] ^ seeds) * U(0x9FB21C651E98DF25)
    mixed ^= mixed >> U(32)
    mixed *= U(0xBF58476D1CE4E5B9)
    drawn = min(drawn, len(shingles))
    least = np.sort(np.argpartition(mixed, drawn - 1, axis=1)[:, :drawn], axis=1)
    out = seeds[:, 0] + U(drawn)
    for i in range(drawn):
        out = out * U(0xD6E8FEB86659FD93) + shingles[least[:, i]]
    return scramble(out)


def sketch_table(df: DataFrame, width: int, count: int, drawn: int) -> DataFrame:
    """(doc_id, digest, sketch): the sketch of a text without words is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                found = []
                for words in word_hashes([t or "" for t in part.column(2).to_pylist()]):
                    s = labelled_shingles(words, width)
                    found.append(sketches(s, count, drawn).astype(np.int64) if len(s) else np.zeros(0, np.int64))
                offsets = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["doc_id", "digest", "sketch"])

    rows = df.select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, sketch array<long>")


def longest_rising(values: np.ndarray) -> int:
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Share of the shingles of two texts that an alignment pairs: pairs / (all - pairs).

    At `similarity` s at least 2s/(1+s) of all shingles are paired, so a pair is never further
    off the diagonal than the rest, and the band of that width loses nothing. Labelled
    shingles are unique in a text, so the best alignment is the longest rising run of places.
    """
    total = len(a) + len(b)
    band = int(total * (1 - similarity) / (1 + similarity)) + 1
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    place = order[at]
    mine = np.flatnonzero(b[place] == a)
    theirs = place[mine]
    pairs = longest_rising(theirs[np.abs(mine - theirs) <= band])
    return pairs / (total - pairs)


def linked(texts: list[np.ndarray], marks: np.ndarray, labels: list[bytes], left: int | None, similarity: float) -> list[tuple[int, int]]:
    """(first of the class, member), as places in `texts`, for all classes of similar texts which share a
    sketch (rows of `marks`). With `left`, only texts before that place are held against those from it
    on. Texts of one label, and pairs already joined, are not aligned."""
    sizes = np.array([len(t) for t in texts])
    ids, local = np.unique(np.concatenate(texts), return_inverse=True)
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    first_of: dict[bytes, int] = {}
    root = [first_of.setdefault(label, i) for i, label in enumerate(labels)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(texts) if left is None else left):
        first = a + 1 if left is None else left
        if first >= len(texts):
            break
        if all(root[b] == root[a] for b in range(first, len(texts))):
            continue
        mark = np.zeros(len(ids), np.int32)
        mark[local[starts[a] : starts[a] + sizes[a]]] = 1
        shared = np.add.reduceat(mark[local[starts[first] :]], starts[first:] - starts[first])
        close = (shared >= similarity * (sizes[a] + sizes[first:] - shared) - 1e-9) & (marks[first:] == marks[a]).any(axis=1)
        for b in (np.flatnonzero(close) + first).tolist():
            if find(a) != find(b) and aligned(texts[a], texts[b], similarity) >= similarity - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [(find(i), i) for i in range(len(texts)) if find(i) != i and labels[find(i)] != labels[i]]


def verify(units: DataFrame, width: int, similarity: float, count: int, drawn: int) -> DataFrame:
    """units: (cell, i, j, side, digest, label, text), sorted so that a unit's rows adjoin -> (cell, u, v): the first of each class
    and its other members. Where a unit has both sides, one is held
    against the other, else its texts against each other."""

    def unit_links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        rows = sorted(rows, key=lambda r: (r[3], r[4]))
        left = next((i for i, r in enumerate(rows) if r[3] != rows[0][3]), None)
        if len(rows) < 2 or len({r[5] for r in rows}) < 2:
            return []
        texts, at = [], 0
        while at < len(rows):
            until, size = at, 0
            while until < len(rows) and (until == at or size + len(rows[until][6]) <= 1 << 20):
                size += len(rows[until][6])
                until += 1
            texts += [labelled_shingles(w, width) for w in word_hashes([r[6] for r in rows[at:until]])]
            at = until
        marks = np.array([sketches(t, count, drawn) for t in texts])
        return [(rows[a][4], rows[b][4]) for a, b in linked(texts, marks, [r[5] for r in rows], left, similarity) if rows[a][4] != rows[b][4]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            links = unit_links(rows)
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(links), pa.binary()), *(pa.array([x[k] for x in links], pa.binary()) for k in (0, 1))], ["cell", "u", "v"])

        for batch in batches:
            for part in slices(batch, 6, SLICE):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held and held[0][:3] != row[:3]:
                        yield out(held)
                        held = []
                    held.append(row)
        if held:
            yield out(held)

    return units.select("cell", "i", "j", "side", "digest", "label", "text").mapInArrow(run, "cell binary, u binary, v binary")


class Verifier:
    """Verified links of candidates in cells, kept in the shared folder."""

    def __init__(self, texts: DataFrame, scratch: Scratch, width: int, similarity: float, count: int, drawn: int):
        self.texts, self.scratch, self.settings = texts, scratch, (width, similarity, count, drawn)
        self.links: list[DataFrame] = []

    def verify(self, units: DataFrame) -> DataFrame:
        """units: (cell, i, j, side, digest, label)."""
        gathered = units.join(self.texts, "digest").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        self.links.append(self.scratch.write(verify(gathered, *self.settings), f"links-{len(self.links)}"))
        return self.links[-1]

    def within(self, groups: DataFrame) -> DataFrame:
        """groups: (cell, block, digest, label): the texts of each block among themselves."""
        return self.verify(groups.select("cell", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "digest", "label"))

    def classes(self, name: str) -> DataFrame:
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        return connected_components(links.sparkSession, links, self.scratch, name).withColumnsRenamed({"node": "digest", "component": "label"})

    def relabelled(self, members: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """members (cell, digest, label) with the labels that links (cell, u, v) lead to."""
        moved = links.groupBy("cell", F.col("v").alias("label")).agg(F.min("u").alias("u"))
        found = members.join(moved, ["cell", "label"], "left").select("cell", "digest", F.coalesce("u", "label").alias("label"))
        return self.scratch.write(found, f"labels-{name}")

    def large_cells(self, large: DataFrame) -> None:
        """large: (cell, digest, weight). First each text meets its cell's hubs, the HUBS texts of most weight. Then
        the first texts of classes meet in blocks until those of a cell fit one block or hardly any are
        joined. Then all texts outside a cell's largest class meet all of the cell."""
        sizes = large.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        first = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("weight"), "digest"))
        hubs = large.withColumn("place", first).where(F.col("place") <= HUBS).drop("place")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        unit = lambda block, side: ("cell", block.alias("i"), F.lit(0).cast("long").alias("j"), F.lit(side).alias("side"), "digest", F.col("digest").alias("label"))
        met = hubs.join(sizes, "cell").select(*unit(each, 0)).unionByName(large.join(sizes, "cell").select(*unit(F.pmod(F.xxhash64("digest"), "blocks"), 1)))
        members = self.relabelled(large.select("cell", "digest", F.col("digest").alias("label")), self.verify(met), "hubs")

        step = 0
        while True:
            leaders = members.where("label = digest").select("cell", "digest")
            counts = leaders.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            before = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
            if not before["all"]:
                break
            dealt = leaders.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("digest", F.lit(step)), F.ceil(F.col("n") / BLOCK)))
            joined = self.within(dealt.withColumn("label", F.col("digest")))
            members = self.relabelled(members, joined, f"step-{step}")
            step += 1
            if before["most"] <= BLOCK or joined.count() < 0.3 * before["all"]:
                break

        counts = members.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("cell").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("inside")).where("n > inside")
        # Blocks 0 .. few - 1 hold what is outside, the further ones the largest class, which needs no pairs of its own.
        few, many = F.ceil((F.col("n") - F.col("inside")) / BLOCK), F.ceil(F.col("inside") / BLOCK)
        left = members.join(main, "cell").withColumns({"outside": F.col("label") != F.col("main"), "few": few, "many": many})
        block = F.when(F.col("outside"), F.pmod(F.xxhash64("digest"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("digest"), "many"))
        last = F.when(F.col("outside"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)
        pairs = left.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        i, j = F.least("block", "other"), F.greatest("block", "other")
        self.verify(pairs.select("cell", i.alias("i"), j.alias("j"), (F.col("block") > i).cast("int").alias("side"), "digest", "label"))


def classes(df: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, count: int = SKETCHES, drawn: int = DRAWN) -> DataFrame:
    """(doc_id, digest, component, lone): a row for each row of `df` (doc_id, text).

    `component` is the same for texts joined by a chain of pairs which share a sketch and whose aligned
    five-word shingles make up `similarity` of all of theirs or more. Words are parted by ASCII white
    space and compared in lower case. Texts without words (null, empty) are joined with nothing:
    `lone` is true. A text with fewer than five words is one shingle; texts of any length are compared
    whole. Equal texts are compared once. Null doc_ids stay, repeated rows fall in one class, an
    empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(sketch_table(df, width, count, drawn), "sketches")
    nodes = rows.where(F.size("sketch") > 0).dropDuplicates(["digest"])
    drawn_rows = nodes.select("digest", F.explode("sketch").alias("bucket"))
    shared = drawn_rows.groupBy("bucket").agg(F.min("digest").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.write(drawn_rows.join(shared, "bucket"), "members")
    parts = connected_components(spark, members.where("digest != lead").select(F.col("digest").alias("u"), F.col("lead").alias("v")).distinct(), scratch, "near")

    # A cell is a whole component of candidates, or, where that is large, each of its buckets. That
    # is only how texts are brought together: pairs are compared if they share a sketch, either way.
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = scratch.write(parts.join(sizes, "component"), "sized")
    whole = sized.where(F.col("size") <= WHOLE_CELL).select(F.col("component").alias("cell"), F.col("node").alias("digest"), "size")
    large = sized.where(F.col("size") > WHOLE_CELL).select(F.col("node").alias("digest"))
    buckets = members.join(large, "digest").select(F.unhex(F.lpad(F.hex("bucket"), 16, "0")).alias("cell"), "digest", F.col("n").alias("size"))
    weights = members.groupBy("digest").agg(F.sum("n").alias("weight"))
    cells = scratch.write(whole.unionByName(buckets).join(weights, "digest"), "cells")

    wanted = sized.select(F.col("node").alias("digest"))
    texts = df.select(text_digest(F.col("text")).alias("digest"), "text").join(wanted.hint("merge"), "digest", "left_semi").dropDuplicates(["digest"])
    texts = scratch.write(texts, "texts", compression="zstd")
    verifier = Verifier(texts, scratch, width, similarity, count, drawn)
    small = cells.where(F.col("size") <= BLOCK)
    verifier.within(small.select("cell", F.lit(0).cast("long").alias("block"), "digest", F.col("digest").alias("label")))
    many = cells.where(F.col("size") > BLOCK).select("cell", "digest", "weight")
    if not many.isEmpty():
        verifier.large_cells(many)
    found = verifier.classes("classes")
    scratch.drop("members", "sized", "cells", "texts")
    joined = rows.join(found, "digest", "left")
    return joined.select("doc_id", "digest", F.coalesce("label", "digest").alias("component"), (F.size("sketch") == 0).alias("lone"))


def near_duplicates(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size): the least doc_id of the class and its number of rows; see classes().
    A class whose ids are all null has a null class_id."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(classes(df, similarity=similarity), "classes")
    groups = rows.where("NOT lone").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    grouped = rows.where("NOT lone").join(groups, "component").select("doc_id", "class_id", "class_size")
    return grouped.unionByName(rows.where("lone").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def deduplicate(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `df` that stay when each class keeps the row with its least doc_id (null first, ties to the
    least digest of the text).

    Null and empty texts, and others without words, stay; of equal rows one stays. All columns of `df`
    stay as they are, whatever their names; an empty table gives an empty table.
    """
    rows = Scratch(df.sparkSession).write(classes(df, similarity=similarity), "classes")
    kept = rows.where("NOT lone").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("kept"))
    kept = kept.select("kept.*").unionByName(rows.where("lone").select("doc_id", "digest").distinct())
    copies = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    kept = kept.join(copies, kept["doc_id"].eqNullSafe(copies["doc_id"]) & (kept["digest"] == copies["digest"])).select(kept["doc_id"].alias(KEPT_ID), kept["digest"].alias(KEPT_TEXT), "copies")

    def staying(chosen: DataFrame) -> DataFrame:
        return df.join(chosen.drop("copies"), (text_digest(F.col("text")) == F.col(KEPT_TEXT)) & F.col("doc_id").cast("long").eqNullSafe(F.col(KEPT_ID)), "left_semi")

    return staying(kept.where("copies = 1")).unionByName(staying(kept.where("copies > 1")).dropDuplicates(["doc_id", "text"]))

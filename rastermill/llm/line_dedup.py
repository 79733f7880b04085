"""Line de-duplication with levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without white space at its ends and with A-Z in lower case. The store
keeps runs of (key hash, documents), dealt into the same buckets by hash and sorted there. Each
batch of documents is merge-anti-joined with the run of keys already known to be frequent and
adds the rest as a run of its own; when a level has `fanout` runs they are merged into one of
the next level, and keys that reach the threshold move to the frequent run. Runs meet bucket by
bucket, so neither join nor merge deals rows out anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm.common import Scratch, text_digest

# Fixed by the contract: the characters that are stripped, and the letters that are lowered.
BLANKS = "\t\n\x0b\x0c\r "
BATCH_ROWS = 1_000_000
LINES_A_BUCKET, MOST_BUCKETS = 250_000, 100_000
MARK, PLACES = "_rastermill_mark", "_rastermill_places"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """For each line what its key depends on: (low, rest).

    Lowering all letters is quick but merges letters outside ASCII too; next to the sequence of
    the line's own characters outside ASCII it says the same as lowering A-Z alone. Only the
    two characters outside ASCII whose lower case begins with an ASCII letter need more care.
    """
    odd = "[\u0130\u212a]"

    def key(line: Column) -> Column:
        plain = F.octet_length(line) == F.length(line)
        low = F.when(plain | ~F.rlike(line, F.lit(odd)), F.lower(F.btrim(line, F.lit(BLANKS)))).otherwise(F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER))
        return F.struct(low.alias("low"), F.when(~plain, F.regexp_replace(line, "[\\x00-\\x7F]+", "")).alias("rest"))

    return F.transform(split_lines(text), key)


def line_hashes(text: Column) -> Column:
    """For each line of a text 128 bits for its key, as two words; null for keys shorter than a character."""
    return F.transform(line_keys(text), lambda k: F.when(F.length(k["low"]) >= 1, F.struct(F.xxhash64(k["low"], k["rest"]).alias("a"), F.xxhash64(F.lit("second"), k["low"], k["rest"]).alias("b"))))


class LineStore:
    """Runs of line hashes in the shared folder, in levels; see the module's text."""

    def __init__(self, spark: SparkSession, min_documents: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.scratch = Scratch(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.frequent: list[str] = []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.table(name)

    def put(self, run: DataFrame) -> str:
        """A run as a table of sorted buckets; its name."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.select("a", "b", "documents").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
        writer.option("path", f"{self.scratch.root}/{name}").option("compression", "snappy").saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.scratch.drop(name)

    def merged(self, names: list[str]) -> DataFrame:
        """The sum of several runs."""
        out = self.read(names[0])
        for name in names[1:]:
            more = self.read(name).withColumnRenamed("documents", "more")
            out = out.join(more.hint("merge"), ["a", "b"], "full").select("a", "b", (F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents"))
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: (a, b, documents), a row for each key."""
        if self.frequent:
            arrived = self.put(batch)
            fresh = self.put(self.read(arrived).join(self.read(self.frequent[0]).hint("merge"), ["a", "b"], "left_anti"))
            self.drop(arrived)
        else:
            fresh = self.put(batch)
        self.levels[0].append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        whole = self.put(self.merged(names))
        often = F.col("documents") >= self.min_documents
        reached, before = self.put(self.read(whole).where(often)), self.frequent
        self.frequent = [self.put(self.merged([*before, reached]))] if before else [reached]
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self.put(self.read(whole).where(~often)))
        self.drop(whole, *names, *(before and [*before, reached]))

    def frequent_keys(self) -> DataFrame:
        """(a, b) of all keys in at least `min_documents` documents, each once."""
        rest = [n for level in self.levels for n in level]
        found = [self.merged(rest).where(F.col("documents") >= self.min_documents)] if rest else []
        found += [self.read(n) for n in self.frequent]
        if not found:
            return self.spark.createDataFrame([], "a long, b long")
        out = found[0].select("a", "b")
        for more in found[1:]:
            out = out.unionByName(more.select("a", "b"))
        return out

    def close(self) -> None:
        self.drop(*(n for level in self.levels for n in level), *self.frequent)


def different(keys: Column) -> Column:
    """Sorted keys, each once."""
    return F.filter(keys, lambda x, i: (i == 0) | (x != F.get(keys, i - 1)))


def frequent_lines(keyed: DataFrame, min_documents: int, batches: int = 4, fanout: int = 2) -> DataFrame:
    """keyed: (batch, keys). (a, b): hashes of the line keys found in at least `min_documents` rows.
    With more batches than `fanout` later batches are anti-joined with what is frequent so far."""
    lines = keyed.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    store = LineStore(keyed.sparkSession, min_documents, fanout, max(1, min(MOST_BUCKETS, -(-lines // LINES_A_BUCKET))))
    ordered = keyed.withColumn("keys", F.array_sort(F.array_compact("keys")))
    for i in range(batches):
        keys = ordered.where(F.col("batch") == i).select(F.explode(different(F.col("keys"))).alias("key"))
        store.add(keys.groupBy("key.a", "key.b").agg(F.count(F.lit(1)).alias("documents")))
    found = store.scratch.write(store.frequent_keys(), "frequent")
    store.close()
    return found


def drop_frequent_lines(df: DataFrame, min_documents: int = 10) -> DataFrame:
    """`df` with frequent lines cut from `text`, plus n_lines and n_dropped (longs).

    A key (at least one character) that occurs in `min_documents` rows or more loses all its
    lines in every row; other lines stay, joined by a newline. Null and empty texts are one empty
    line and become empty; texts of any length are cut whole. Each repeated row counts as a document.
    Other columns stay as they are, null doc_ids included (columns called n_lines or n_dropped are
    replaced, no other name clashes); an empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession)
    batches = max(4, min(16, df.count() // BATCH_ROWS))
    keyed = df.select(text_digest(F.col("text")).alias("digest"), line_hashes(F.col("text")).alias("keys")).withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(batches)).cast("int"))
    keyed = scratch.write(keyed, "keyed", ["batch"])
    found = frequent_lines(keyed, min_documents, batches)
    lines_of = keyed.select("digest", F.posexplode("keys").alias("place", "key")).select("digest", "place", "key.a", "key.b")
    hits = lines_of.join(found, ["a", "b"], "left_semi")  # where `found` is large, Spark splits a line that is in very many texts
    marks = scratch.write(hits.groupBy("digest").agg(F.collect_set("place").alias("places")), "marks")
    scratch.drop("keyed")
    marks = marks.select(F.col("digest").alias(MARK), F.col("places").alias(PLACES))
    joined = df.join(marks, text_digest(F.col("text")) == F.col(MARK), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = split_lines(text)

    def kept_of(each: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col(PLACES))
        return F.array_join(F.transform(left, lambda i: F.get(each, i)), "\n")

    # The lines are bound once: an expression would be split again for each line.
    kept = F.when(F.col(PLACES).isNull(), text).otherwise(F.transform(F.array(lines), kept_of)[0])
    others = [kept.alias(c) if c.lower() == "text" else F.col(c) for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    dropped = F.coalesce(F.size(PLACES), F.lit(0))
    return joined.select(*others, F.size(lines).cast("long").alias("n_lines"), F.when(F.col(PLACES).isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"))

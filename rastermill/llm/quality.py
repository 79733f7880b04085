"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on each text. Expectation-maximisation
over the vote patterns estimates how accurate each labeller is and, for each pattern, how likely
the text is good. Those likelihoods are the labels from which a hashed linear scorer learns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import Scratch, slices
from rastermill.llm.shingles import scramble, word_hashes

FEATURES, TRAINING_ROWS, ROUNDS, EPOCHS, SHARDS, SLICE = 1 << 14, 12_000, 4, 4, 8, 64
GOOD, BAD, NONE = 1, -1, 0

LABELLERS = ("symbols", "odd_endings", "capitals", "exclamations", "repeated_lines", "repeated_words", "variety", "tables", "bare_marks", "plain_words", "sentences", "empty")


# Kinds of characters, as bits.
LETTER, CAPITAL, DIGIT, MARK, SYMBOL, SHOUT, BAR, STOP, BREAK, BLANK = (1 << i for i in range(10))
MARKS, SYMBOLS = ".,;:!?'\"()-\u2019\u00ab\u00bb", "#%&$*@^~=<>\\_"


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point."""
    chars = np.arange(0x110000, dtype=np.uint32).view("U1")
    out = LETTER * np.strings.isalpha(chars).astype(np.uint16) | CAPITAL * np.strings.isupper(chars).astype(np.uint16) | DIGIT * np.strings.isdigit(chars).astype(np.uint16)
    for chars, bit in ((MARKS, MARK), (SYMBOLS, SYMBOL), ("!", SHOUT), ("|", BAR), (".!?", STOP), ("\n", BREAK | BLANK), (" \t\r\x0b\x0c", BLANK)):
        for s in chars:
            out[ord(s)] |= bit
    return out


class Page:
    """A text's words: their hashes, and which kinds of characters each holds."""

    def __init__(self, text: str, words: np.ndarray):
        self.words, self.text = words, text
        self.kind = kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = (self.kind & BLANK) != 0
        self.starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(blank) else np.zeros(0, int)
        self.ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) if len(blank) else np.zeros(0, int)

    def count(self, bits: int) -> np.ndarray:
        """For each word its number of characters of these kinds."""
        if not len(self.starts):
            return np.zeros(0, int)
        return np.add.reduceat(((self.kind & bits) != 0).astype(np.int32), self.starts)

    def again(self) -> np.ndarray:
        return np.r_[False, self.words[1:] == self.words[:-1]][: len(self.words)]


def votes(page: Page) -> tuple[int, ...]:
    """GOOD, BAD or NONE for each of LABELLERS; most only know bad texts, plain_words and sentences
    also good ones."""
    n = len(page.starts)
    if not n:
        return (NONE,) * (len(LABELLERS) - 1) + (BAD,)
    bad = lambda found: BAD if found else NONE
    size = page.ends - page.starts + 1
    share = lambda bits: ((page.kind & bits) != 0).sum() / n
    last = page.kind[page.ends]
    lines = [x.strip() for x in page.text.split("\n") if x.strip()]
    known = page.count(LETTER | DIGIT | MARK)
    plain = ((known == size) & (page.count(MARK) <= 2)).mean()
    ended = sum(x[-1] in ".!?" for x in lines) / max(1, len(lines))
    letters = share(LETTER)
    return (
        bad(share(SYMBOL) >= 0.3),
        bad(((last & (LETTER | DIGIT | MARK)) == 0).mean() >= 0.3),
        bad(n >= 4 and share(CAPITAL) >= 0.5 * letters > 0),
        bad(share(SHOUT) >= 0.3),
        bad(len(lines) >= 4 and 1 - len(set(lines)) / len(lines) >= 0.35),
        bad(n >= 8 and page.again().mean() >= 0.1),
        bad(n >= 20 and len(np.unique(page.words)) / n <= 0.15),
        bad(share(BAR) >= 0.15),
        bad(((size == 1) & ((last & (LETTER | DIGIT)) == 0)).mean() >= 0.15),
        GOOD if plain >= 0.97 else BAD if plain < 0.6 else NONE,
        GOOD if ended >= 0.8 and share(SHOUT) < 0.1 else NONE,
        NONE,
    )


def read_pages(texts: list[str]) -> list[Page]:
    return [Page(t, w) for t, w in zip(texts, word_hashes(texts), strict=True)]


class LabelModel:
    """P(good), and for each labeller P(vote | good or bad), by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, steps: int = 100):
        """patterns: rows of votes, counts: how many texts have each."""
        n = len(LABELLERS)
        self.prior = 0.9
        self.table = np.zeros((n, 2, 3))  # labeller, bad/good, vote + 1
        self.table[:, 0] = [0.3, 0.6, 0.1]
        self.table[:, 1] = [0.02, 0.48, 0.5]
        if not len(counts):
            return
        shown = np.stack([(patterns == v) for v in (BAD, NONE, GOOD)], axis=2).astype(float)
        for _ in range(steps):
            good = self.posterior(patterns)
            for side, weight in ((0, counts * (1 - good)), (1, counts * good)):
                seen = np.einsum("p,pjv->jv", weight, shown) + 1.0
                self.table[:, side] = seen / seen.sum(axis=1, keepdims=True)
            self.prior = float(np.clip((counts @ good) / counts.sum(), 0.02, 0.98))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(len(LABELLERS))
        likelihood = np.log(self.table[at, :, patterns + 1]).sum(axis=1)  # patterns x bad/good
        margin = likelihood[:, 1] - likelihood[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def hashed(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed features: its words, and their shapes (which kinds of
    characters a word holds, and whether it repeats the word before); the values have length one."""
    n = min(len(page.words), len(page.starts))
    if not n:
        return np.array([0]), np.array([1.0])
    shape = page.again()[:n].astype(np.uint64)
    for i, bits in enumerate((CAPITAL, DIGIT, SYMBOL, SHOUT, BAR, STOP)):
        shape |= (page.count(bits)[:n] > 0).astype(np.uint64) << np.uint64(i + 1)
    shape |= (page.count(CAPITAL)[:n] > 1).astype(np.uint64) << np.uint64(7)
    names = np.concatenate([page.words[:n], scramble(shape + np.uint64(1))])
    places, counts = np.unique((names >> np.uint64(20)) % np.uint64(FEATURES), return_counts=True)
    values = np.sqrt(counts)
    return places.astype(np.int64), values / np.sqrt((values**2).sum())


def vote_table(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found = [list(votes(p)) for p in read_pages([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), part.column(2)], ["doc_id", "votes", "key"])

    rows = df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("key"))
    return rows.mapInArrow(run, "doc_id long, votes array<int>, key long")


def fit_scorer(sample: DataFrame) -> np.ndarray:
    """sample: (places, values, label, key), at most TRAINING_ROWS rows. Shards, dealt by `key`, run over their
    rows in its order, each on its own, and their weights are averaged, ROUNDS times; so the weights
    don't depend on how the sample is stored."""
    weights = np.zeros(FEATURES + 1)
    dealt = sample.withColumn("shard", F.pmod("key", F.lit(SHARDS)).cast("int"))

    def round_of(start: np.ndarray, rate: float):
        def run(rows: pa.Table) -> pa.Table:
            w = start.copy()
            held = [(np.array(p), np.array(v), y) for p, v, y in zip(*(c.to_pylist() for c in rows.sort_by("key").select(["places", "values", "label"]).columns), strict=True)]
            for _ in range(EPOCHS):
                for places, values, label in held:
                    p = 1 / (1 + np.exp(-np.clip(w[places] @ values + w[-1], -30, 30)))
                    np.add.at(w, places, rate * (label - p) * values)
                    w[-1] += 0.1 * rate * (label - p)
            return pa.table({"shard": rows["shard"][:1], "weights": pa.array([w.tolist()], pa.list_(pa.float64())), "n": pa.array([len(held)], pa.int64())})

        return run

    for step in range(ROUNDS):
        found = dealt.groupBy("shard").applyInArrow(round_of(weights, 2.0 / (1 + step)), "shard int, weights array<double>, n long").collect()  # SHARDS rows
        if found:
            found.sort(key=lambda r: r["shard"])
            weights = np.average([r["weights"] for r in found], axis=0, weights=[r["n"] for r in found])
    return weights


def classify(df: DataFrame) -> DataFrame:
    """(doc_id, votes, weak_label, score, predicted) for each row of `df` (doc_id, text).

    `weak_label` is the label model's probability that the text is good, `score` the scorer's, and
    `predicted` is 1 for a score of one half or more. The label model counts the vote patterns
    of all rows (at most 3 ** len(LABELLERS) come to the driver); the scorer learns from the
    TRAINING_ROWS rows with the least hashes, equal rows once. Null and empty texts are voted bad; texts
    of any length are read whole. Null doc_ids stay, repeated rows are scored each, an empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    voted = scratch.write(vote_table(df), "votes")
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([r["votes"] for r in counted], int).reshape(-1, len(LABELLERS))
    model = LabelModel(patterns, np.array([r["n"] for r in counted], float))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                pages = read_pages([t or "" for t in part.column(0).to_pylist()])
                label = model.posterior(np.array([votes(p) for p in pages]).reshape(-1, len(LABELLERS)))
                found = [hashed(p) for p in pages]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64())), pa.array(label), part.column(1)], ["places", "values", "label", "key"])

    chosen = voted.select("key").distinct().orderBy("key").limit(TRAINING_ROWS).agg(F.max("key")).first()[0]
    few = df.where(F.xxhash64("doc_id", "text") <= F.lit(chosen)) if chosen is not None else df.limit(0)
    few = few.groupBy(F.xxhash64("doc_id", "text").alias("key")).agg(F.min("text").alias("text"))
    sample = scratch.write(few.select("text", "key").mapInArrow(features, "places array<int>, values array<double>, label double, key long"), "sample")
    scratch.drop("votes")
    weights = fit_scorer(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                pages = read_pages([t or "" for t in part.column(1).to_pylist()])
                margin = np.array([weights[p] @ v + weights[-1] for p, v in map(hashed, pages)])
                s = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                found = np.array([votes(p) for p in pages])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.tolist(), pa.list_(pa.int32())), pa.array(model.posterior(found)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "votes", "weak_label", "score", "predicted"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, votes array<int>, weak_label double, score double, predicted int")


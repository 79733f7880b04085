"""Toxicity by compression distance.

Texts are cut into windows of a few words. An ordinary dictionary begins as plain ordinary text; the
windows of toxic texts that it compresses worst train the first toxic dictionary, those of
ordinary texts the rest of the ordinary one. In each further round a dictionary is trained again,
on the windows that the other one compresses worse: the toxic one on windows of toxic texts, the
ordinary one on its false alarms. Both end in the same ordinary text, so that they differ only
where they learnt something else. A window's distance is how much shorter the toxic dictionary
makes it. Thresholds on the distances are calibrated on labelled texts that trained neither; of
several sizes of dictionaries those stay that tell these texts apart best.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import Scratch, slices

WORDS, LEVEL, LEAST_MATCH = 5, 3, 5
SAMPLE_ROWS, CALIBRATION_SHARE = 6_000, 4
BASE_BYTES, DICTIONARY_BYTES, SEGMENT, GRAM, ROUNDS = 1_000_000, (8_192, 16_384, 32_768), 32, 8, 2
WORST, TRAINING_WINDOWS, LEAST_GAIN = 0.2, 50_000, 2
GAINS = (1, 2, 3, 4, 6)
PART_WINDOWS = 100_000
TOKEN = re.compile(r"\w+")


def windows(text: str) -> list[bytes]:
    words = TOKEN.findall(text.lower())
    return [f" {' '.join(words[i : i + WORDS])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WORDS)]


def compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    """Compresses with the dictionary's text alone, without frame fields or its literal statistics."""
    raw = zstandard.ZstdCompressionDict(dictionary or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(dictionary), min_match=LEAST_MATCH, hash_log=17, chain_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
    raw.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=settings).compress


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of `size` bytes trained on windows; where they are too few to train one,
    the windows themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=GRAM, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def sample_ids(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic, part, share): of each label at most `rows` ids, those with the least hashes. `part`
    0 is for calibration; `share` is how many labelled ids a chosen one stands for."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def first(toxic: int) -> DataFrame:
        n = counts.get(toxic, 0)
        return known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("share", F.lit(n / max(1, min(n, rows))))

    return first(0).unionByName(first(1)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(CALIBRATION_SHARE)))


def window_table(rows: DataFrame) -> DataFrame:
    """(toxic, window): the different windows of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part for batch in batches for part in slices(batch, 0))
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = list(dict.fromkeys(windows(text or "")))
                for at in range(0, len(found), PART_WINDOWS):
                    some = found[at : at + PART_WINDOWS]
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(some), pa.int32()), pa.array(some, pa.binary())], ["toxic", "window"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, window binary")


def measured(table: DataFrame, left: bytes, right: bytes | None) -> DataFrame:
    """Adds `gain`: how much shorter `right` makes a window than `left`; without `right` how much longer
    than usual a window of its length is under `left`, in tenths of a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = compressor(left), compressor(right) if right is not None else None
        for batch in batches:
            found = batch.column(1).to_pylist()
            gain = [len(first(w)) - len(second(w)) for w in found] if second else [10 * len(first(w)) - 4 * len(w) for w in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gain, pa.int32())], ["toxic", "window", "gain"])

    return table.select("toxic", "window").mapInArrow(run, "toxic int, window binary, gain int")


def chosen(table: DataFrame, toxic: int, order: list[Column], most: int) -> list[bytes]:
    """At most `most` windows of one label, the first in `order`."""
    return [bytes(r["window"]) for r in table.where(F.col("toxic") == toxic).orderBy(*order, F.xxhash64("window")).select("window").limit(most).collect()]


def learn_dictionaries(sample: DataFrame, scratch: Scratch) -> list[tuple[bytes, bytes]]:
    """(toxic, ordinary) of sample (text, toxic) for each size; at most TRAINING_WINDOWS windows a time
    come to the driver."""
    table = scratch.write(window_table(sample.repartition(12)), "windows", compression="zstd")
    base, size = [], 0
    for w in chosen(table, 0, [], BASE_BYTES // 20):
        if size < BASE_BYTES:
            base.append(w)
            size += len(w)
    plain = b"".join(base)
    costs = scratch.write(measured(table, plain, None), "costs", compression="zstd")
    border = costs.where("toxic = 1").agg(F.percentile_approx("gain", F.lit(1 - WORST))).first()[0]
    worst = [chosen(costs.where(F.col("gain") >= F.lit(border)), toxic, [F.desc("gain")], TRAINING_WINDOWS) for toxic in (0, 1)]
    out = []
    for size in DICTIONARY_BYTES:
        ordinary, toxic = (train_dictionary(w, size) + plain for w in worst)
        for step in range(1, ROUNDS):
            gains = scratch.write(measured(table, ordinary, toxic).where(F.col("gain") >= LEAST_GAIN), f"gains-{size}-{step}", compression="zstd")
            won, alarms = (chosen(gains, label, [F.desc("gain")], TRAINING_WINDOWS) for label in (1, 0))
            toxic, ordinary = train_dictionary(won or worst[1], size) + plain, train_dictionary(alarms + worst[0], size) + plain
            scratch.drop(f"gains-{size}-{step}")
        out.append((toxic, ordinary))
    scratch.drop("windows", "costs")
    return out


class Distances:
    """The distances of a text's windows, counted, as features; dictionaries are digested once a task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def gains(self, text: str) -> np.ndarray:
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)], np.int64)

    def features(self, text: str) -> np.ndarray:
        gain = self.gains(text)
        n = max(len(gain), 1)
        counts = np.array([(gain >= g).sum() for g in GAINS], float)
        return np.r_[counts / np.sqrt(n), counts[1:] / n, np.log1p(counts[1:]), (gain <= -LEAST_GAIN).sum() / np.sqrt(n), np.clip(gain.max(initial=0), 0, 12) / 12, np.log(n)]


def feature_rows(toxic: bytes, ordinary: bytes, use):
    """mapInArrow function: hands (batch, features of its rows) to `use`, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(toxic, ordinary)
        for batch in batches:
            for part in slices(batch, 1):
                yield use(part, np.array([distances.features(t or "") for t in part.column(1).to_pylist()]))

    return run


class Calibration:
    """Logistic regression on the features; the threshold of the best F1 is moved to one half."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: np.ndarray):
        self.mean, self.spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (0.0, 1.0)
        width = x.shape[1] + 1
        self.weights, self.shift = np.zeros(width), 0.0
        if not len(y) or y.min() == y.max():
            self.shift, self.quality = 3.0 if not len(y) or y.max() == 0 else -3.0, 0.0
            return
        a = self.design(x)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ self.weights, -30, 30)))
            slope = a.T @ (share * (p - y)) + 2.0 * np.r_[self.weights[:-1], 0]
            self.weights -= np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + 2.0 * np.eye(width), slope)
        margin = a @ self.weights
        order = np.argsort(-margin, kind="stable")
        hits, seen = np.cumsum((y * share)[order]), np.cumsum(share[order])
        f1 = 2 * hits / (seen + (y * share).sum())
        best = int(np.argmax(f1))
        self.shift, self.quality = float(margin[order][best : best + 2].mean()), float(f1[best])

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.spread, -4, 4), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights - self.shift, -30, 30)))


def learn(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[bytes, bytes, Calibration]:
    """df: (doc_id, text), labels: (doc_id, toxic). Of each label at most `rows` ids are learnt from, one
    in CALIBRATION_SHARE of them for the thresholds; only their texts are read, never shuffled."""
    scratch = Scratch(df.sparkSession)
    ids = scratch.write(sample_ids(labels, rows).coalesce(1), "ids")
    found = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # at most 2 * rows ids
    sample = scratch.write(found.groupBy("doc_id", "toxic", "part", "share").agg(F.min("text").alias("text")), "sample", compression="zstd")
    tried = learn_dictionaries(sample.where("part <> 0"), scratch)
    held = scratch.write(sample.where("part = 0").select("toxic", "text", "share").repartition(12), "held", compression="zstd")

    def use(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "share", "features"])

    def calibrated(toxic: bytes, ordinary: bytes) -> Calibration:
        seen = held.mapInArrow(feature_rows(toxic, ordinary, use), "toxic int, share double, features array<double>").collect()
        seen.sort(key=lambda r: (r["toxic"], r["features"]))
        x = np.array([r["features"] for r in seen]).reshape(-1, len(Distances(toxic, ordinary).features("")))
        return Calibration(x, np.array([r["toxic"] for r in seen], float), np.array([r["share"] for r in seen], float))

    models = [(*pair, calibrated(*pair)) for pair in tried]
    scratch.drop("ids", "sample", "held")
    return max(models, key=lambda m: m[2].quality)


def score(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score, predicted) for each row of `df` (doc_id, text); labels: (doc_id, toxic), learnt
    from with the texts that `df` has for them.

    Null and empty texts score like any text without windows; texts of any length are measured whole,
    window by window. Without labelled rows, or with labels of one kind, every text gets the same score.
    Labels other than 0 and 1 and null labels and ids don't count; of labels that clash 1 holds, of texts
    that share an id the least is learnt. Null doc_ids stay, repeated rows are scored each, an empty
    table gives no rows; other columns are not read.
    """
    toxic, ordinary, model = learn(df, labels, rows)

    def use(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        s = model.score(x)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(feature_rows(toxic, ordinary, use), "doc_id long, score double, predicted int")

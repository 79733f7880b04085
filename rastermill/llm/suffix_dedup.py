"""Removal of passages that occur more than once, by sorted suffixes.

Every window of `span` bytes is filed under its anchor, the k-gram in it with the least hash: equal
windows have equal anchors at the same place. A document's windows with one anchor adjoin and
make a piece. Only pieces whose anchor occurs again are looked at, each distinct piece once,
all pieces of an anchor together. There the suffixes of the pieces, read in words of eight bytes
counted from the anchor, are sorted (see suffix_groups), and windows whose words agree are told
apart by the bytes at their two ends. Two pieces that share a window agree in half of its rest
on one side of the anchor, so pieces that are alone with both their sides are left out before.
Equal pieces are told by 128 bits of their bytes; an anchor that has one distinct piece needs no
sorting, for all its windows occur as often as the piece. Anchors and sides are 64-bit hashes:
a collision there brings pieces together that are then told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import Scratch, slices, text_digest
from rastermill.llm.shingles import U, powers, scramble
from rastermill.llm.suffix_groups import suffix_array

SPAN, GRAM, WORD = 200, 32, 8
BATCH_WORDS, HOT_PIECES, CHUNK = 60_000, 4_000, 4 << 20


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)


def prefix_sums(text: bytes) -> np.ndarray:
    up, _ = powers(1 << max(16, len(text).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values()[np.frombuffer(text, np.uint8)] * up[: len(text)])])


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [begin, end), the same wherever they stand."""
    down = powers(1 << max(16, (len(sums) - 1).bit_length()))[1]
    return scramble((sums[end] - sums[begin]) * down[begin])


COLUMNS = ("anchor", "left", "right", "first", "windows", "place")


def pieces(text: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, hashes of the sides left and right of the anchor, 0 where a side is cut off by the
    text's end, first window, number of windows, anchor's place in the first window). Long texts are
    cut into chunks that share all but one byte of a window, so that each window stands in one."""
    found = [chunk_pieces(text[at : at + CHUNK + span - 1], span, gram) for at in range(0, max(1, len(text) - span + 1), CHUNK)]
    for i, f in enumerate(found):
        f[3][:] += i * CHUNK
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def chunk_pieces(text: bytes, span: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(text)
    if n < span:
        return tuple(np.zeros(0, t) for t in (*[np.uint64] * 3, *[np.int64] * 3))
    sums = prefix_sums(text)
    grams = range_hashes(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
    wide = span - gram + 1
    count = len(grams) - wide + 1
    # Ordered by the upper half of the hash and then by place, so that the leftmost of equals wins.
    # The least of each window comes from minima running forwards and backwards in blocks.
    placed = (grams & U(0xFFFFFFFF << 32)) | np.arange(len(grams), dtype=np.uint64)
    rows = np.append(placed, np.full(-len(placed) % wide, U(2**64 - 1))).reshape(-1, wide)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(backward[:count], forward[wide - 1 : wide - 1 + count]) & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    windows = np.diff(np.r_[first, count])
    at, side = anchor[first], (span - gram) // 2
    left = np.where(at >= side, range_hashes(sums, np.maximum(at - side, 0), at), U(0))
    right = np.where(at + gram + side <= n, range_hashes(sums, at + gram, np.minimum(at + gram + side, n)), U(0))
    return grams[at], left, right, first, windows, at - first


def piece_table(df: DataFrame, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                found = [pieces(t, span) for t in raw]
                owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                cols = [np.concatenate([f[i] for f in found]) for i in range(6)]
                content = [xxhash.xxh3_128_digest(t[a : a + n + span - 1]) for t, f in zip(raw, found, strict=True) for a, n in zip(f[3].tolist(), f[4].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), pa.array(content, pa.binary()), *(pa.array(c.view(np.int64)) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])],
                    ["digest", "content", *COLUMNS],
                )

    rows = df.select(text_digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, "digest binary, content binary, anchor long, left long, right long, first int, windows int, place int")


def repeated_windows(texts: list[bytes], windows: list[int], places: list[int], copies: list[int], span: int) -> list[np.ndarray]:
    """For each piece the windows (counted from its first) whose bytes occur in another piece of the
    list, or in another copy of the same."""
    words = span // WORD
    columns, origin, base = [], [], []
    total = 0
    for text, place in zip(texts, places, strict=True):
        lead = -place % WORD  # words are counted from the anchor
        size = -(-(lead + len(text)) // WORD)
        raw = bytes(lead) + text + bytes(size * WORD - lead - len(text))
        columns.append(np.frombuffer(raw, ">u8"))
        origin.append(lead)
        base.append(total)
        total += size + 1
    symbols = np.zeros(total, np.int64)
    packed = np.zeros(total + words + 2, np.uint64)
    for b, c in zip(base, columns, strict=True):
        packed[b : b + len(c)] = c
    ranks = np.unique(np.concatenate(columns), return_inverse=True)[1] + 1
    done = 0
    for b, c in zip(base, columns, strict=True):
        symbols[b : b + len(c)] = ranks[done : done + len(c)]
        done += len(c)
    order = suffix_array(symbols)

    # Suffixes that agree in the words a window surely covers whole (all but one) are a class.
    core = words - 1
    padded = np.append(symbols, np.full(core, -1))
    same = np.ones(len(order) - 1, bool)
    for i in range(core):
        same &= padded[order[1:] + i] == padded[order[:-1] + i]
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(np.r_[0, ~same])

    out = []
    owner, start = np.repeat(np.arange(len(texts)), windows), np.concatenate([np.arange(w) for w in windows])
    byte = start + np.array(origin)[owner]
    word, shift = np.array(base)[owner] + byte // WORD, byte % WORD
    left = packed[word] & (U(2**64 - 1) >> (shift * 8).astype(np.uint64))
    right = np.where(shift > 0, packed[word + core + 1] >> ((WORD - shift) * 8 % 64).astype(np.uint64), U(0))
    keys = np.rec.fromarrays([shift, classes[word + 1], left, right])
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = (count[inverse] > 1) | (np.array(copies)[owner] > 1)
    borders = np.cumsum(np.r_[0, windows])
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        out.append(np.flatnonzero(often[a:b]))
    return out


def runs(places: np.ndarray) -> list[int]:
    """Sorted places as begin, end, begin, end ..."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.r_[0, cut + 1]], places[np.r_[cut, len(places) - 1]] + 1], axis=1).ravel().tolist()


def sort_pieces(rows: DataFrame, span: int) -> DataFrame:
    """rows: (anchor, content, copies, windows, place, bytes), an anchor's rows adjoining ->
    (anchor, content, repeated array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = repeated_windows([r[5] for r in held], [r[3] for r in held], [r[4] for r in held], [r[2] for r in held], span)
            keep = [(r[0], r[1], runs(f)) for r, f in zip(held, found, strict=True) if len(f)]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.binary()), pa.array([k[2] for k in keep], pa.list_(pa.int32()))], ["anchor", "content", "repeated"])

        for batch in batches:
            for part in slices(batch, 5):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if size > BATCH_WORDS and row[0] != held[-1][0]:
                        yield out()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5]) // WORD + 2
        if held:
            yield out()

    return rows.select("anchor", "content", "copies", "windows", "place", "bytes").mapInArrow(run, "anchor long, content binary, repeated array<int>")


def hash_windows(rows: DataFrame, span: int) -> DataFrame:
    """Pieces of an anchor with too many for one task: (anchor, content, copies, window, hash binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, copies, windows, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = [hashlib.blake2b(data[i : i + span], digest_size=16).digest() for i in range(windows)]
                full = lambda x, t: pa.array([x] * windows, t)
                yield pa.RecordBatch.from_arrays([full(anchor, pa.int64()), full(content, pa.binary()), full(copies, pa.int64()), pa.array(np.arange(windows, dtype=np.int32)), pa.array(hashes, pa.binary())], ["anchor", "content", "copies", "window", "hash"])

    return rows.select("anchor", "content", "copies", "windows", "bytes").mapInArrow(run, "anchor long, content binary, copies long, window int, hash binary")


def cut_pieces(wanted: DataFrame, span: int) -> DataFrame:
    """wanted: (text, parts array of structs) -> a row for each part, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in slices(batch, 0)):
            for text, parts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([p[k] for p in parts], t) for k, t in (("anchor", pa.int64()), ("content", pa.binary()), ("copies", pa.int64()), ("hot", pa.bool_()), ("windows", pa.int32()), ("place", pa.int32()))), pa.array([raw[p["first"] : p["first"] + p["windows"] + span - 1] for p in parts], pa.binary())],
                    ["anchor", "content", "copies", "hot", "windows", "place", "bytes"],
                )

    return wanted.select("text", "parts").mapInArrow(run, "anchor long, content binary, copies long, hot boolean, windows int, place int, bytes binary")


def spans(df: DataFrame, span: int = SPAN) -> DataFrame:
    """(digest, spans array<int>): for each text that loses something, begin and end of the byte ranges
    it loses, in order and apart from each other."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    every = scratch.write(piece_table(df, span), "pieces")
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = scratch.write(every.join(again, "anchor", "left_semi"), "shared")
    scratch.drop("pieces")
    one = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("digest", "first", "windows", "place", "left", "right")).alias("at"))
    one = scratch.write(one.select("anchor", "content", "copies", "at.*"), "one")
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("hash")), F.struct(F.lit(1).alias("side"), F.col("right").alias("hash")))).alias("s")
    sides = one.select("anchor", "content", side).select("anchor", "content", "s.side", "s.hash").where("hash <> 0")
    met = sides.groupBy("anchor", "side", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = sides.join(met, ["anchor", "side", "hash"], "left_semi").select("anchor", "content").distinct()
    kept = one.join(near.withColumn("near", F.lit(True)), ["anchor", "content"], "left").where("near OR copies > 1").drop("near", "left", "right")
    kept = scratch.write(kept, "kept")
    size = kept.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"))
    sized = scratch.write(kept.join(size, "anchor").withColumn("hot", F.col("size") > HOT_PIECES), "sized")
    scratch.drop("one", "kept")
    alone = sized.where("size = 1 AND copies > 1").select("anchor", "content", F.array(F.lit(0), "windows").alias("repeated"))
    parts = sized.where("size > 1").groupBy("digest").agg(F.collect_list(F.struct("anchor", "content", "copies", "hot", "first", "windows", "place")).alias("parts"))
    texts = df.select(text_digest(F.col("text")).alias("digest"), "text").dropDuplicates(["digest"])
    cut = scratch.write(cut_pieces(texts.join(parts, "digest"), span), "cut")

    cold = cut.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor")
    windows = scratch.write(hash_windows(cut.where("hot"), span), "windows")
    often = windows.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash")
    warm = windows.join(often, "hash", "left_semi").groupBy("anchor", "content").agg(F.array_sort(F.collect_list("window")).alias("places"))
    singles = F.flatten(F.transform("places", lambda x: F.array(x, x + 1)))
    found = scratch.write(sort_pieces(cold, span).unionByName(warm.select("anchor", "content", singles.alias("repeated"))).unionByName(alone), "repeated")
    scratch.drop("cut", "sized", "windows")
    placed = shared.select("digest", "anchor", "content", "first").join(found, ["anchor", "content"])
    places = F.transform("repeated", lambda x: x + F.col("first")).alias("places")
    by_text = placed.select("digest", places).groupBy("digest").agg(F.flatten(F.collect_set("places")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            lists = batch.column(1)
            values, borders = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                pairs = values[a:b].astype(np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                ends = np.maximum.accumulate(pairs[:, 1] + span - 1)
                begin = np.flatnonzero(np.r_[True, pairs[1:, 0] > ends[:-1]])
                merged.append(np.stack([pairs[begin, 0], ends[np.r_[begin[1:] - 1, len(ends) - 1]]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.list_(pa.int32()))], ["digest", "spans"])

    return scratch.write(by_text.mapInArrow(run, "digest binary, spans array<int>"), "spans")


def remove_repeats(df: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept binary): a row for each row of `df` (doc_id, text).

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of `span` bytes that covers it
    starts anywhere else too, in the same text or another row's, judged on the input. `kept` is
    what stays, not always valid UTF-8. Equal texts lose everything if they are `span` bytes long
    or more. Texts of any length are judged whole, chunk by chunk. Null doc_ids and repeated rows stay,
    each row counts; an empty table gives no rows; other columns are not read.
    """
    found = spans(df, span)
    rows = df.select("doc_id", text_digest(F.col("text")).alias("digest"), "text").join(found, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in slices(batch, 1)):
            out: list[tuple] = []
            for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw, cuts = (text or "").encode("utf-8", "surrogatepass"), cuts or []
                borders = [0, *cuts, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(cuts) // 2, cuts, kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary")

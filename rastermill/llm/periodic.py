"""Runs of words that repeat with a period, found by lags in parallel over the words' bits.

The ids of a text's words are kept as bit planes, one big integer for each binary digit. For a lag q the planes
XORed with themselves q places on, ORed, mark the places that differ from the word q later; stretches
without a mark of q places or more are runs, and are isolated by ANDs whose shifts double.

Short lags are all tried. A longer lag, from B to 2B, is tried only where some aligned block of B/2 words stands
again that far on, which each of its runs must show; blocks whose repetition an already known run of a
divisor explains don't count. So a text of n words costs n log n and one pass over its planes for each lag
that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import slices

# Fixed by the contract: what parts words, and the least length of a run.
BLANKS = "\t\n\x0b\x0c\r "
LEAST_WORDS = 12
SHORT_LAGS = 64
MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    text = text or ""
    for blank in BLANKS[:-1]:
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def planes_of(ids: np.ndarray) -> list[int]:
    """A big integer for each binary digit of the ids; bit i belongs to word i."""
    digits = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits(ids >> b & 1, bitorder="little").tobytes(), "little") for b in range(digits)]


def long_ones(bits: int, length: int) -> int:
    """Marks where `length` ones in a row begin."""
    have = 1
    while have < length and bits:
        step = min(have, length - have)
        bits &= bits >> step
        have += step
    return bits


def stretches(bits: int, size: int) -> list[tuple[int, int]]:
    """(begin, end) of each stretch of ones."""
    flags = np.unpackbits(np.frombuffer(bits.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    turns = np.flatnonzero(np.diff(np.r_[np.int8(0), flags, np.int8(0)]))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def repeating_lags(sums: np.ndarray, n: int, base: int, runs: dict[tuple[int, int], int]) -> np.ndarray:
    """Lags from `base` to twice that at which an aligned block of base / 2 words stands again, but where a run that
    is known with a divisor of the lag as its period holds both. `sums` has those of all blocks."""
    block = base // 2
    most = min(2 * base - 1, n - block)
    if most < base:
        return np.zeros(0, np.int64)
    at = np.arange(0, n - block - base + 1, block)
    reach = np.lib.stride_tricks.sliding_window_view(np.r_[sums, np.zeros(2 * base, np.uint64)], base)[at + base]
    same = (reach == sums[at][:, None]) & (at[:, None] + base + np.arange(base) <= n - block)
    for (begin, end), period in runs.items():
        if end - begin < base + block:
            continue
        first, last = -(-begin // block), min((end - base - block) // block, len(at) - 1)
        if last < first:
            continue
        lags = np.arange(-(-base // period) * period, 2 * base, period)
        inside = at[first : last + 1, None] + lags + block <= end
        some = same[first : last + 1, lags - base]
        same[first : last + 1, lags - base] = some & ~inside
    return base + np.flatnonzero(same.any(axis=0))


def doubled(sums: np.ndarray, block: int) -> np.ndarray:
    """From the sums of all blocks of `block` words those of twice as many, words weighed by powers: equal blocks have
    equal sums, whatever their place."""
    weight = np.uint64(pow(MULTIPLIER, block, 1 << 64))
    return sums[:-block] + weight * sums[block:]


def find_runs(words: list[str], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period: a stretch of at least `least` words and two
    periods, that no neighbour prolongs, with its smallest period."""
    n = len(words)
    if n < least:
        return []
    places: dict[str, int] = {}
    ids = np.array([places.setdefault(w, len(places)) for w in words], np.int64)
    if len(places) == n:
        return []
    planes, every = planes_of(ids), (1 << n) - 1
    runs: dict[tuple[int, int], int] = {}

    def test(lag: int) -> None:
        differ = 0
        for plane in planes:
            differ |= plane ^ plane >> lag
        length = max(least - lag, lag)
        same = ~differ & every >> lag
        if same.bit_count() < length:
            return
        begins = long_ones(same, length)
        if begins:
            for begin, end in stretches(begins, n):
                runs.setdefault((begin, end + length - 1 + lag), lag)  # smaller periods came first

    for lag in range(1, min(SHORT_LAGS, n // 2 + 1)):
        test(lag)
    if n >= 2 * SHORT_LAGS:
        base, block = SHORT_LAGS, 1
        sums = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        sums ^= sums >> np.uint64(32)
        while base <= n // 2:
            while block < base // 2:
                sums, block = doubled(sums, block), 2 * block
            for lag in repeating_lags(sums, n, base, runs).tolist():
                if lag <= n // 2:
                    test(lag)
            base *= 2
    return sorted(((b, e - b, q) for (b, e), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that stay when of each run only the first period does, joined by spaces."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def periodic_runs(df: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): for each row of `df` (doc_id, text) all runs of words, as (start, length,
    period), ordered by start and period, and the text without the repetitions, its words joined by spaces.

    Words are parted by ASCII white space. A null or empty text has no words and no runs, and collapses to an empty
    text; texts of any length are searched whole. Runs that overlap all count, and a word goes if any
    run repeats it. Repeated rows, null doc_ids and ties need no care: each row is searched alone. An
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 1):
                counts, found, texts = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    runs = find_runs(words, least)
                    counts.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    texts.append(collapsed(words, runs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(df: DataFrame) -> DataFrame:
    """(doc_id, text): rows whose crc32 of the id, in decimal digits, is a multiple of ten get a repetition: with g a
    tenth of it, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8), word i >= a becomes word a + (i - a) % p.
    Other rows, those without words and those without an id stay as they are."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce((code % 10 == 0) & F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))

    def repeat(words):
        n, g = F.size(words).cast("long"), F.floor(code / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    bound = F.transform(F.array(words), repeat)[0]  # the words are bound once, for an expression is made anew for each use
    return df.select("doc_id", F.when(chosen, bound).otherwise(F.col("text")).alias("text"))

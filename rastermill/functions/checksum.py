"""CRC64 of whole texts, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions import constants as K

# Texts are cut into chunks whose sums run side by side.
CHUNK = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
EIGHT, LOW = np.uint64(8), np.uint64(255)


def byte_table() -> np.ndarray:
    state = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        state = np.where(state & np.uint64(1), (state >> np.uint64(1)) ^ np.uint64(K.CRC64_POLYNOMIAL & 0xFFFFFFFFFFFFFFFF), state >> np.uint64(1))
    return state


TABLE = byte_table()


def stepped(state: np.ndarray, data: np.ndarray) -> np.ndarray:
    return TABLE[(state ^ data) & LOW] ^ (state >> EIGHT)


def chunk_tables() -> list[np.ndarray]:
    """For each byte of a state what it has become after CHUNK zero bytes; states add up by xor."""
    out = []
    for place in range(8):
        state = np.arange(256, dtype=np.uint64) << np.uint64(8 * place)
        for _ in range(CHUNK):
            state = stepped(state, np.uint64(0))
        out.append(state)
    return out


SKIP = chunk_tables()


def skipped(state: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for place, table in enumerate(SKIP):
        out ^= table[(state >> np.uint64(8 * place)) & LOW]
    return out


def crc64_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the byte runs data[start : start + size].

    Zero bytes leave a zero state as it is, so runs are padded at their front to whole chunks; the
    first state, all ones, is the same as the first eight bytes inverted.
    """
    out = np.zeros(len(sizes), np.uint64)
    for i in np.flatnonzero(sizes < 8):
        state = ALL
        for byte in data[starts[i] : starts[i] + sizes[i]]:
            state = stepped(state, np.uint64(byte))
        out[i] = state
    order = np.flatnonzero(sizes >= 8)
    order = order[np.argsort(-sizes[order], kind="stable")]  # longest first, so that those still running are a prefix
    counts = -(-sizes[order] // CHUNK)
    firsts = np.cumsum(counts) - counts
    chunks = np.arange(int(counts.sum())) - np.repeat(firsts, counts)
    begin = np.repeat(sizes[order] - counts * CHUNK, counts) + chunks * CHUNK
    start = np.repeat(starts[order], counts)
    parts = np.zeros(len(chunks), np.uint64)
    for i in range(CHUNK):
        place = begin + i
        byte = data[np.maximum(start + place, 0)].astype(np.uint64)
        parts = stepped(parts, np.where(place < 0, np.uint64(0), np.where(place < 8, byte ^ LOW, byte)))
    state = np.zeros(len(order), np.uint64)
    for chunk in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -chunk, side="left"))
        state[:live] = skipped(state[:live]) ^ parts[firsts[:live] + chunk]
    out[order] = state
    return out ^ ALL


def text_crc64(rows: DataFrame) -> DataFrame:
    """rows (key, text) -> (key, crc): of the UTF-8 bytes of each whole text, as 16 upper-case digits. An
    empty text has 16 zeros, a null text null."""
    key, text = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            data = np.frombuffer(b"".join(t or b"" for t in texts) + b"\0", np.uint8)
            found = crc64_of(data, np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else f"{c:016X}" for t, c in zip(texts, found.tolist(), strict=True)], pa.string())], [key, "crc"])

    return rows.select(key, F.col(text).cast("binary")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, crc string")


# Sums of texts that follow each other. A sum is a polynomial over two elements, its lowest bit the highest power; zero bytes
# behind a text multiply its sum.
POLYNOMIAL, ONE = K.CRC64_POLYNOMIAL & (1 << 64) - 1, 1 << 63


def times(a: int, b: int) -> int:
    """The product of two polynomials, modulo that of the sum."""
    out = 0
    for i in range(63, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def zeros(count: int) -> int:
    """What `count` zero bytes multiply a sum by."""
    out, square = ONE, ONE >> 8
    while count:
        if count & 1:
            out = times(out, square)
        square, count = times(square, square), count >> 1
    return out


def combined(first: int, second: int, size: int) -> int:
    """The sum of two texts one after the other, from theirs and the size of the second."""
    return times(zeros(size), first) ^ second


def ordered_crc64(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, n_texts, n_bytes, crc): the checksum of all texts of a group, one after the other in the order of a column, as
    16 upper-case digits; texts that tie stand in their own order. Null texts count as empty, null keys are a group.

    Rows are sorted in ranges of key and order, so that a large group spans tasks; each task hands on one sum for each group that it
    met, and those are combined."""
    names = [*keys, "part", "n_texts", "n_bytes", "sum"]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held = TaskContext.get().partitionId(), None, [0, 0, 0]

        def out() -> pa.RecordBatch:
            values = [*key, part, held[0], held[1], f"{held[2]:016X}"]
            return pa.RecordBatch.from_arrays([pa.array([v], batch.schema.field(i).type if i < len(keys) else None) for i, v in enumerate(values)], names)

        for batch in batches:
            found = list(zip(*(c.to_pylist() for c in batch.columns[: len(keys)]), strict=True))
            texts = [t or b"" for t in batch.column(len(keys)).to_pylist()]
            begin = 0
            while begin < len(found):
                end = next((i for i in range(begin, len(found)) if found[i] != found[begin]), len(found))
                if found[begin] != key:
                    if key is not None:
                        yield out()
                    key, held = found[begin], [0, 0, 0]
                data = b"".join(texts[begin:end])
                sum_ = int(crc64_of(np.frombuffer(data + b"\0", np.uint8), np.zeros(1, np.int64), np.array([len(data)], np.int64))[0])
                held = [held[0] + end - begin, held[1] + len(data), combined(held[2], sum_, len(data))]
                begin = end
        if key is not None:
            yield out()

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        sum_ = 0
        parts = parts.sort_values("part")
        for each, size in zip(parts["sum"], parts["n_bytes"], strict=True):
            sum_ = combined(sum_, int(each, 16), int(size))
        return parts.iloc[:1][keys].assign(n_texts=parts["n_texts"].sum(), n_bytes=parts["n_bytes"].sum(), crc=f"{sum_:016X}")

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    data = F.col(text).cast("binary")
    ranged = rows.select(*keys, data.alias("_text"), F.col(order).alias("_order")).repartitionByRange(*keys, "_order", "_text").sortWithinPartitions(*keys, "_order", "_text")
    sums = ranged.select(*keys, "_text").mapInArrow(run, f"{schema}, part long, n_texts long, n_bytes long, sum string")
    return sums.groupBy(*keys).applyInPandas(whole, f"{schema}, n_texts long, n_bytes long, crc string")

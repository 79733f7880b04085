"""The entropy coder: numbers below known bounds as one integer state, streamed bit by bit.

A stream is one chain of states; streams are rows, and a kernel takes many of them a number at a time. Streams
of more than LONG numbers are coded alone.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastermill.functions import columns as C
from rastermill.functions.constants import SLOTS, STATE_BITS

LEAST = 1 << STATE_BITS
LONG, BATCH_STREAMS = 4096, 64
ENTRY = "array<struct<value:bigint,max:bigint>>"


def entry(value: Column, bound: Column) -> Column:
    return F.struct(C.long(value).alias("value"), C.long(bound).alias("max"))


def entries(*items: Column) -> Column:
    """Entries that carry information: those with a bound above 1."""
    return F.filter(F.array(*items), lambda e: e["max"] > 1)


def size_entries(value: Column) -> list[Column]:
    """An image side: its magnitude, then the rest."""
    bits = C.log2floor(value - 1)
    base = F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))
    return [entry(bits - 3, F.lit(8)), entry(value - base - 1, base)]


def header_entries(width: Column, height: Column, code: Column, line_limit: Column, color: Column) -> Column:
    """The stream's header; line_limit is the effective one."""
    parts = [entry(p, F.lit(n)) for p, n in zip(C.split_code(code), (4, 5, 5, 5), strict=True)]
    return entries(*size_entries(width), *size_entries(height), *parts, entry(line_limit - 1, F.lit(63)), entry(color, F.lit(49)))


def slot_range(value: int, bound: int) -> tuple[int, int]:
    """The first slot of a value and its number of slots."""
    first = value * SLOTS // bound
    return first, (value + 1) * SLOTS // bound - first


def push(state: int, numbers: Iterable[tuple[int, int]], bits: list[int]) -> int:
    """Codes (value, bound) pairs into a state; what overflows is appended to `bits`."""
    for value, bound in numbers:
        first, width = slot_range(value, bound)
        ceiling = 2 * LEAST * width // SLOTS
        while state >= ceiling:
            bits.append(state & 1)
            state >>= 1
        state = state // width * SLOTS + state % width + first
    return state


def quietest_start(numbers: list[tuple[int, int]]) -> int:
    """Of the start states that are tried, the first whose overflow begins with most zeros."""
    trials = np.arange(LEAST, 2 * LEAST + 28, 32)
    state, zeros, silent = trials.copy(), np.zeros(len(trials), int), np.ones(len(trials), bool)
    for value, bound in numbers:
        first, width = slot_range(value, bound)
        ceiling = 2 * LEAST * width // SLOTS
        while (over := state >= ceiling).any():
            silent &= ~over | (state & 1 == 0)
            zeros += over & silent
            state = np.where(over, state >> 1, state)
        state = state // width * SLOTS + state % width + first
    return int(trials[zeros.argmax()])


def encode(values: list[int], bounds: list[int]) -> bytes:
    """The stream for a list of numbers. Numbers are coded from the last to the first; the start
    state is the one that makes most of the trailing bits zero, for those are cut."""
    numbers = [(v, m) for v, m in zip(values, bounds, strict=True) if m > 1][::-1]
    head, room = len(numbers), 4.3e9
    for i, (_, bound) in enumerate(numbers):
        room /= bound
        if room < 1:
            head = i + 1
            break
    start = quietest_start(numbers[:head])
    bits: list[int] = []
    state = push(start, numbers, bits)
    stream = [state >> i & 1 for i in range(STATE_BITS)] + bits[::-1]
    return np.packbits(np.array(stream, np.uint8), bitorder="little").tobytes().rstrip(b"\0")


class Reader:
    """Numbers from a stream, given their bounds one by one; past its end a stream is all zeros."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").tolist()
        self.at = 0
        self.state = LEAST
        for i in range(STATE_BITS):
            self.state |= self.bit() << i

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 0

    def number(self, bound: int) -> int:
        if bound < 2:
            return 0
        slot = self.state % SLOTS
        value = (slot * bound + bound - 1) // SLOTS
        first, width = slot_range(value, bound)
        self.state = width * (self.state // SLOTS) + slot - first
        while self.state < LEAST:
            self.state = self.state << 1 | self.bit()
        return value

    def size(self, octal: bool = False) -> int:
        """An image side; `octal` reads the older form of streams, digits of base 8 until a stop."""
        if octal:
            value = -1
            while True:
                value = 8 * value + self.number(8) + 8
                if value >= 8 and not self.number(2):
                    return value
        bits = self.number(8) + 3
        return (1 << bits) + 1 + self.number(1 << bits)


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), fill, np.int32)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def shifts(state: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """How many bits a state loses before it is below a ceiling. States are below 4 * LEAST, so the number is that
    for LEAST or one or two more."""
    least = np.zeros_like(ceiling)
    for i in range(STATE_BITS):
        least += (LEAST >> i) >= ceiling
    return least + (state >= ceiling << least) + (state >= ceiling << least + 1)


def pushed(state: np.ndarray, width: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state after a number; the quotient of such small numbers is exact in floating point."""
    whole = ((state + 0.5) * (1.0 / width)).astype(np.int32)
    return state + whole * (SLOTS - width) + first


TRAILING = np.array([STATE_BITS + 2, *((i & -i).bit_length() - 1 for i in range(1, 4 * LEAST))], np.int32)


def encode_batch(values: list[np.ndarray], bounds: list[np.ndarray]) -> list[bytes]:
    """encode() for many streams."""
    rows = [(v[m > 1][::-1], m[m > 1][::-1]) for v, m in zip(values, bounds, strict=True)]
    value, bound = padded([v for v, _ in rows], 0), padded([m for _, m in rows], 1)
    n, length = len(rows), value.shape[1]
    first = value * SLOTS // bound
    width = (value + 1) * SLOTS // bound - first
    ceiling = 2 * LEAST * width // SLOTS
    live = bound > 1
    # As in encode(): the head ends with the number whose bound brings the room below 1.
    room = np.divide.accumulate(np.column_stack([np.full(n, 4.3e9), bound.astype(float)]), axis=1)[:, 1:]
    inside = live & (np.column_stack([np.full(n, 4.3e9), room])[:, :length] >= 1)

    trials = np.arange(LEAST, 2 * LEAST + 28, 32, dtype=np.int32)
    state, zeros, silent = np.tile(trials, (n, 1)), np.zeros((n, len(trials)), np.int32), np.ones((n, len(trials)), bool)
    for k in range(length):
        use = np.flatnonzero(inside[:, k])
        if not len(use):
            break
        now, w, f, c = state[use], width[use, k, None], first[use, k, None], ceiling[use, k, None]
        lost, clear = shifts(now, c), TRAILING[now]
        zeros[use] += np.where(silent[use], np.minimum(lost, clear), 0)
        silent[use] &= clear >= lost
        state[use] = pushed(now >> lost, w, f)
    state = trials[zeros.argmax(axis=1)]

    bits = np.zeros((n, length * (STATE_BITS + 1) + STATE_BITS), np.uint8)
    at = np.zeros(n, np.int64)
    for k in range(length):
        use = np.flatnonzero(live[:, k])
        now, w = state[use], width[use, k]
        lost = shifts(now, ceiling[use, k])
        for i in range(int(lost.max(initial=0))):
            more = lost > i
            bits[use[more], at[use[more]] + i] = now[more] >> i & 1
        at[use] += lost
        state[use] = pushed(now >> lost, w, first[use, k])
    place = np.arange(bits.shape[1])
    tail = np.take_along_axis(bits, np.maximum(at[:, None] - 1 - place, 0), axis=1) * (place < at[:, None])
    stream = np.column_stack([(state[:, None] >> np.arange(STATE_BITS) & 1).astype(np.uint8), tail.astype(np.uint8)])
    return [row.tobytes().rstrip(b"\0") for row in np.packbits(stream, axis=1, bitorder="little")]


def decode_batch(streams: list[bytes], bounds: list[np.ndarray]) -> list[list[int]]:
    """The numbers of many streams, given all their bounds."""
    bound = padded(bounds, 1).astype(np.int64)
    n, length = bound.shape
    size = max(map(len, streams), default=0)
    raw = np.zeros((n, size + 1), np.uint8)
    for i, s in enumerate(streams):
        raw[i, : len(s)] = np.frombuffer(s, np.uint8)
    bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
    past = bits.shape[1] - 1  # zeros, as is all beyond a stream's end
    each = np.arange(n)
    state, at = np.full(n, LEAST), np.full(n, STATE_BITS)
    for i in range(STATE_BITS):
        state |= bits[each, min(i, past)] << i
    out = np.zeros((n, length), np.int64)
    for k in range(length):
        use = np.flatnonzero(bound[:, k] > 1)
        b, now = bound[use, k], state[use]
        slot = now % SLOTS
        value = (slot * b + b - 1) // SLOTS
        begin = value * SLOTS // b
        now = ((value + 1) * SLOTS // b - begin) * (now // SLOTS) + slot - begin
        low = now < LEAST
        while low.any():
            mine = use[low]
            now[low] = now[low] << 1 | bits[mine, np.minimum(at[mine], past)]
            at[mine] += 1
            low = now < LEAST
        out[use, k], state[use] = value, now
    return [row[: len(b)].tolist() for row, b in zip(out, bounds, strict=True)]


def in_batches(sizes: list[int], short, alone) -> list:
    """Results in the order of `sizes`: of streams up to LONG numbers by short(places), alike ones together, of
    others by alone(place)."""
    out: list = [None] * len(sizes)
    order = sorted((i for i, n in enumerate(sizes) if n <= LONG), key=lambda i: sizes[i])
    for begin in range(0, len(order), BATCH_STREAMS):
        part = order[begin : begin + BATCH_STREAMS]
        for i, found in zip(part, short(part), strict=True):
            out[i] = found
    for i, n in enumerate(sizes):
        if n > LONG:
            out[i] = alone(i)
    return out


@F.pandas_udf(T.BinaryType())
def encode_stream(entries: pd.Series) -> pd.Series:
    """A column of entry lists -> streams."""
    values, bounds = ([np.array([e[name] for e in row], np.int64) for row in entries] for name in ("value", "max"))
    # Equal lists, of which short streams have many, are coded once.
    names = [v.tobytes() + m.tobytes() for v, m in zip(values, bounds, strict=True)]
    once = list({name: i for i, name in enumerate(names)}.values())
    coded = in_batches([len(values[i]) for i in once], lambda part: encode_batch([values[once[i]] for i in part], [bounds[once[i]] for i in part]), lambda i: encode(values[once[i]].tolist(), bounds[once[i]].tolist()))
    known = {names[i]: c for i, c in zip(once, coded, strict=True)}
    return pd.Series([known[name] for name in names])


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_stream(data: pd.Series, bounds: pd.Series) -> pd.Series:
    """Streams and their bounds -> the numbers."""
    streams, limits = [bytes(s) for s in data], [np.asarray(b, np.int64) for b in bounds]

    def alone(i: int) -> list[int]:
        reader = Reader(streams[i])
        return [reader.number(int(m)) for m in limits[i]]

    return pd.Series(in_batches([len(b) for b in limits], lambda part: decode_batch([streams[i] for i in part], [limits[i] for i in part]), alone))


def entropy_bits(items: Column) -> Column:
    """Bits that a list of entries is worth."""
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + F.log2(e["max"].cast("double")))

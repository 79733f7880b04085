"""Decoding streams. Each number's bound depends on the geometry read before it, so a stream is
parsed by one kernel; what it gives are spans, painted as a plain join-free explode."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rastermill.functions import constants as K
from rastermill.functions.dimensions import COS, SIN
from rastermill.operators.deal import dealt
from rastermill.operators.entropy import Reader
from rastermill.operators.geometry import paint


def truncated(a: np.ndarray, b: int) -> np.ndarray:
    return np.sign(a) * (np.abs(a) // b)


class Header:
    """What a stream says before its nodes."""

    def __init__(self, read: Reader, older: bool):
        self.width, self.height = read.size(older), read.size(older)
        f1, f2, f3, f4 = (read.number(n) for n in (K.F1, K.F2, K.F3, K.F4))
        self.partition_code = f1 + K.F1 * (f2 + K.F2 * (f3 + K.F3 * f4))
        self.line_limit = read.number(K.LINE_LIMITS) + 1
        self.color = read.number(K.COLOR_CODES)
        self.bits = [max(0, 9 - f1 - i - i * f4 // 2) for i in range(K.LEVELS)]
        self.scale, scale = [], (self.width**2 + self.height**2) * (f2 + 2) ** 2 & K.U32
        for _ in range(K.LEVELS):
            self.scale.append(int(scale / K.LEVEL_BASE))
            if older:  # neither wraps nor truncates between levels
                scale = scale * K.LEVEL_STEP / K.LEVEL_DIVISORS[f3]
            else:
                scale = (scale * K.LEVEL_STEP & K.U32) // K.LEVEL_DIVISORS[f3]
        self.quant = 1 + (4 + (self.color & 3) << (self.color >> 2)) if self.color < K.FIRST_PALETTE_CODE else 0
        self.palette_size = max(0, self.color - K.FIRST_PALETTE_CODE + 1)

    def level(self, spans: np.ndarray) -> int:
        dx, dy = spans[:, 2].max() - spans[:, 1].min(), np.ptp(spans[:, 0]) + 1
        return next((i for i, s in enumerate(self.scale) if dx * dx + dy * dy >= s), K.LEVELS - 1)


def lines_across(spans: np.ndarray, sn: int, cs: int, limit: int, older: bool) -> tuple[int, int, int, int]:
    """(low, high, line quantum, number of lines)."""
    y, x0, x1 = spans.T
    low, high = int((cs * y + sn * x0).min()), int((cs * y + sn * (x1 - 1)).max())
    quant = K.SCALE
    if older:
        while (high - low) // quant > limit:
            quant += quant >> 4
    elif high - low > quant * limit:
        quant = (2 * (high - low) + limit) // (2 * limit)
    return low, high, quant, max(1, (high - low) // quant)


def cut(spans: np.ndarray, sn: int, cs: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    y, x0, x1 = spans.T
    at = np.where(y * cs >= d, x0, x1) if sn == 0 else np.clip(truncated(2 * d + sn - 2 * y * cs, 2 * sn), x0, x1)
    left, right = np.column_stack([y, at, x1]), np.column_stack([y, x0, at])
    return left[left[:, 1] < left[:, 2]], right[right[:, 1] < right[:, 2]]


def walk(data: bytes, older: bool = False) -> tuple[Header, list[tuple] | None]:
    """The header, and of each node in the order of the stream (name, spans, colour or None, level, angle, line); None for a
    stream that names an empty region or a side beyond the largest."""
    read = Reader(data)
    head = Header(read, older)
    if max(head.width, head.height) > K.LARGEST_SIDE:
        return head, None
    palette = [tuple(read.number(256) for _ in range(3)) for _ in range(head.palette_size)]
    rows = np.arange(head.height)
    queue = [("", np.column_stack([rows, np.zeros_like(rows), np.full_like(rows, head.width)]))]
    nodes = []
    for name, spans in queue:
        split = read.number(2)
        if not len(spans):
            return head, None
        if not split:
            if palette:
                color = palette[read.number(len(palette))]
            else:
                color = tuple(255 * read.number(head.quant) // (head.quant - 1) for _ in range(3))
            nodes.append((name, spans, color, None, None, None))
            continue
        level = head.level(spans)
        bits = head.bits[level]
        angle = read.number(1 << bits) << 9 - bits
        sn, cs = int(SIN[angle]), int(COS[angle])
        low, high, quant, n = lines_across(spans, sn, cs, head.line_limit, older)
        line = read.number(n)
        d = low + (high - low - (n - 1) * quant) // 2 + quant * line if n > 1 else (high + low & K.U32) // 2
        nodes.append((name, spans, None, level, angle, line))
        queue += [(name + side, part) for side, part in zip("LR", cut(spans, sn, cs, d), strict=True)]
    return head, nodes


def parse(data: bytes, older: bool = False) -> tuple[Header, list[tuple[tuple[int, ...], np.ndarray]] | None]:
    """The header and, for each leaf, its colour and spans; None for a stream that can't be read."""
    head, nodes = walk(data, older)
    return head, None if nodes is None else [(color, spans) for _, spans, color, *_ in nodes if color is not None]


def nodes_of(data: bytes) -> Iterator[tuple]:
    """(name, level, angle, line, r, g, b, pixels) of each node; nothing for a stream that can't be read."""
    for name, spans, color, level, angle, line in walk(data)[1] or []:
        yield (name, level, angle, line, *(color or (None,) * 3), int((spans[:, 2] - spans[:, 1]).sum()))


def decode_spans(streams: DataFrame, older: bool = False) -> DataFrame:
    """streams (image_id, data) -> (image_id, width, height, leaf, y, x0, x1, r, g, b). A stream that can't
    be read gives no rows. `older` reads the earlier dialect."""

    def rows_of(data: bytes) -> np.ndarray:
        """All of COLUMNS but the image."""
        head, leaves = parse(data, older)
        if not leaves:
            return np.zeros((0, len(COLUMNS) - 1), np.int64)
        colors, spans = zip(*leaves, strict=True)
        which = np.repeat(np.arange(len(leaves)), [len(s) for s in spans])
        sides = np.broadcast_to(np.array([head.width, head.height], np.int64), (len(which), 2))
        return np.column_stack([sides, which, np.concatenate(spans), np.array(colors, np.int64)[which]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, held, begin, count = batch["image_id"].to_numpy(), [], 0, 0
            for i, data in enumerate(batch["data"]):
                held.append(rows_of(bytes(data)))
                count += len(held[-1])
                if count >= SPANS_A_TURN or i == len(batch) - 1:
                    rows = pd.DataFrame(np.concatenate(held), columns=COLUMNS[1:])
                    yield rows.assign(image_id=np.repeat(ids[begin : i + 1], [len(h) for h in held]))[COLUMNS]
                    held, begin, count = [], i + 1, 0

    schema = ", ".join(f"{c} {'int' if c == 'leaf' else 'long'}" for c in COLUMNS)
    return dealt(streams.where("data IS NOT NULL").select("image_id", "data"), "image_id").mapInPandas(run, schema)


SPANS_A_TURN = 100_000
COLUMNS = ["image_id", "width", "height", "leaf", "y", "x0", "x1", "r", "g", "b"]


def decode_images(streams: DataFrame, older: bool = False) -> DataFrame:
    """streams (image_id, data) -> pixels."""
    return paint(decode_spans(streams, older))


def read_headers(streams: DataFrame) -> DataFrame:
    """(image_id, width, height, partition_code, line_limit, color), line_limit the effective one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [Header(Reader(bytes(d)), False) for d in batch["data"]]
            yield pd.DataFrame({"image_id": batch["image_id"], **{k: [getattr(h, k) for h in heads] for k in ("width", "height", "partition_code", "line_limit", "color")}})

    return dealt(streams.where("data IS NOT NULL").select("image_id", "data"), "image_id").mapInPandas(run, "image_id long, width long, height long, partition_code long, line_limit long, color long")

"""Encoding texts as sentence pieces and back, with the place of each piece in the source.

A text is normalised by the longest prefixes that the model's compiled character map knows; each
byte of the result remembers the source byte it came from, which projects every piece to a span of
the original bytes. Pieces are merged best pair first. Merges can't cross two characters that stand
side by side in no piece, so a text is cut there and most parts are ones that a task has seen before.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import slices
from rastermill.llm.pairs import Pairs, found

# Fixed values of the model's format: kinds of pieces, the sign for white space, what malformed bytes become.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE, REPLACEMENT = "▁", "�"
BPE = 2
SHORT_PART, HEAP_FROM, CACHED_PARTS = 64, 48, 100_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of an encoded message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled map of byte sequences to others: a double-array trie and the results it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.results = blob[4 + size :]

    def step(self, at: int, byte: int) -> int | None:
        """The place of a node's child, or None."""
        at ^= byte
        unit = self.units[at] if at < len(self.units) else 0
        return at if unit & 0x800000FF == byte else None

    @staticmethod
    def offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def longest(self, data: bytes, begin: int) -> tuple[bytes, int] | None:
        """What the longest known prefix of data[begin:] becomes, and its length."""
        if not self.units:
            return None
        found, at = None, self.offset(self.units[0])
        for i in range(begin, len(data)):
            node = self.step(at, data[i])
            if node is None:
                break
            unit = self.units[node]
            at = node ^ self.offset(unit)
            if unit >> 8 & 1:
                found = self.units[at] & 0x7FFFFFFF, i + 1 - begin
        if found is None:
            return None
        end = self.results.index(b"\0", found[0])
        return self.results[found[0] : end], found[1]


class Model:
    """The pieces of a model file and how it merges them."""

    def __init__(self, path: str):
        self.names, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        with open(path, "rb") as file:
            for number, value in fields(file.read()):
                if number == 1:
                    piece = dict(fields(value))
                    self.names.append(piece[1].decode())
                    self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    self.kinds.append(piece.get(3, NORMAL))
                elif number == 2:
                    trainer |= dict(fields(value))
                elif number == 3:
                    normalizer |= dict(fields(value))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or not trainer.get(35, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only models of merged pairs with byte fallback, without unused or user-defined pieces are read")
        self.prefix, self.squeeze, escape = (bool(normalizer.get(n, 1)) for n in (3, 4, 5))
        if not escape:
            raise ValueError("only models that write white space as a sign are read")
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.map = CharacterMap(normalizer.get(2, b""))
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        self.rank = {n: self.scores[i] for n, i in self.ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        bytes_ = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [bytes_.get(i, self.unknown) for i in range(256)]
        self.byte_of = {i: b for b, i in bytes_.items()}
        self.pairs = {n[i : i + 2] for n in self.ids for i in range(len(n) - 1)}
        joined = {c for pair in self.pairs for c in pair}
        # Where no piece has the sign after another character, or a newline beside anything, texts are cut by a pattern.
        alone = "" if "\n" in joined else "\n"
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|\n") if not any(p[1] == SPACE != p[0] for p in self.pairs) else re.compile("(?s).+")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tables()
        self.plain = np.array([k in (NORMAL, BYTE) for k in self.kinds])
        shown = [bytes([self.byte_of[i]]) if i in self.byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]
        self.shown, self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8), np.array(list(map(len, shown)))
        self.shown_at = np.cumsum(self.shown_bytes) - self.shown_bytes

    # Normalising

    def normalize(self, data: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, a place in `data`."""
        if not self.map.units and not self.squeeze:
            try:
                return self.plainly(data)
            except UnicodeDecodeError:
                pass
        return self.by_prefixes(data)

    def plainly(self, data: bytes) -> tuple[str, np.ndarray]:
        text = data.decode()
        widths = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        places = np.repeat(np.arange(len(data), dtype=np.int32), widths)
        front = [np.zeros(3, np.int32)] if self.prefix and data else []
        return (SPACE if front else "") + text.replace(" ", SPACE), np.concatenate([*front, places, np.array([len(data)], np.int32)])

    def prefixes(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(what it becomes, begin, length) for each prefix taken from `data` in turn."""
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                size = well_formed(data, at)
                found = (data[at : at + size], size) if size else (REPLACEMENT.encode(), 1)
            yield found[0], at, found[1]
            at += found[1]

    def by_prefixes(self, data: bytes) -> tuple[str, np.ndarray]:
        out, places, end = bytearray(), [], 0
        sign, spaced, begun = SPACE.encode(), self.squeeze, False
        for result, at, size in self.prefixes(data):
            if not begun and self.squeeze and result == b" ":
                end = at + size  # at the front white space goes
                continue
            if not begun and self.prefix:
                out += sign
                places += [at] * 3
            begun = True
            if spaced:
                result = result.lstrip(b" ")
            if result:
                spaced = self.squeeze and result.endswith(b" ")
                shown = result.replace(b" ", sign)
                out += shown
                places += [at] * len(shown)
            if not self.squeeze:
                spaced = False
            end = at + size
        while self.squeeze and out.endswith(sign):
            end = places[len(out) - 3]
            del out[-3:], places[-3:]
        return out.decode(), np.array([*places, end], np.int32)

    # Merging

    def merge(self, symbols: list[str]) -> list[str]:
        """Joins the best pair, of equals the first, until none is a piece."""
        rank = self.rank.get
        if len(symbols) > HEAP_FROM:
            return self.merge_many(symbols)
        scores = [rank(a + b) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while True:
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                return symbols
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank(symbols[i - 1] + symbols[i])
            if i < len(scores):
                scores[i] = rank(symbols[i] + symbols[i + 1])

    def merge_many(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                whole = symbols[left] + symbols[right]
                score = self.rank.get(whole)
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, whole))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, whole = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != whole:
                continue
            symbols[left], symbols[right] = whole, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def code(self, part: str) -> bytes:
        """Ids of a part's pieces, as 32-bit numbers; a character that no piece has gives those of its bytes."""
        ids, begin = [], 0
        for end in range(1, len(part) + 1):
            if end < len(part) and part[end - 1 : end + 1] in self.pairs:
                continue
            for symbol in self.merge(list(part[begin:end])):
                known = self.ids.get(symbol)
                ids += [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]
            begin = end
        return np.array(ids, np.int32).tobytes()

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """How many normalised bytes each piece of a text has; of a character's bytes the last has them all."""
        sizes = self.piece_bytes[ids]
        at = np.flatnonzero(sizes == 0)
        if len(at):
            value = self.byte_value[ids[at]]
            lead = np.flatnonzero(value & 0xC0 != 0x80)
            sizes[at[np.r_[lead[1:], len(at)] - 1]] = np.diff(np.r_[lead, len(at)])
        return sizes

    def code_many(self, parts: list[str]) -> list[bytes]:
        """code() for many parts, in arrays. Long parts, and those with characters that no piece has, are coded alone."""
        if not parts:
            return []
        lengths = np.array(list(map(len, parts)))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.int32).astype(np.int64)
        begins = np.zeros(len(points), bool)
        begins[np.cumsum(lengths) - lengths] = True
        begins[1:] |= found(self.beside, points[:-1] << 21 | points[1:]) < 0
        live = np.repeat(lengths <= HEAP_FROM, lengths)
        symbol, place = self.merges.join(self.symbol[points[live]], begins[live])
        owner = np.repeat(np.arange(len(parts)), np.where(lengths <= HEAP_FROM, lengths, 0))[place]
        ends = np.searchsorted(owner, np.arange(len(parts)), side="right")
        alone = lengths > HEAP_FROM
        alone[owner[symbol >= len(self.names)]] = True
        ids, out, begin = symbol.astype(np.int32).tobytes(), [], 0
        for part, end, slow in zip(parts, (ends * 4).tolist(), alone.tolist(), strict=True):
            out.append(self.code(part) if slow else ids[begin:end])
            begin = end
        return out

    def tables(self) -> None:
        """Symbols are ids of pieces, or the number of pieces and a character's code for those that are none."""
        n = len(self.names)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        rank = np.unique(-np.array(self.scores), return_inverse=True)[1].tolist()
        made = {}
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                a, b = (self.ids.get(x, int(self.symbol[ord(x)]) if len(x) == 1 else -1) for x in (name[:k], name[k:]))
                if min(a, b) >= 0:
                    made[a, b] = rank[i], i
        self.merges = Pairs(made)
        self.beside = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in self.pairs), np.int64)
        self.piece_bytes = np.array([len(x.encode()) if k == NORMAL else 0 for x, k in zip(self.names, self.kinds, strict=True)], np.int32)
        self.byte_value = np.array([self.byte_of.get(i, 0) for i in range(n)])

    def encode_many(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of the pieces of each text in UTF-8. Parts of up to SHORT_PART characters are kept,
        2 * CACHED_PARTS of them and those of one call at most."""
        normal = [self.normalize(t) for t in texts]
        parted = [self.parts.findall(t) for t, _ in normal]
        used = set(chain.from_iterable(parted))
        if len(self.young) >= CACHED_PARTS:
            self.old, self.young = self.young, {}
        known, missing = self.young, used.difference(self.young)
        known.update((p, self.old[p]) for p in missing if p in self.old)
        new = [p for p in missing if p not in self.old]
        known.update(zip(new, self.code_many(new), strict=True))
        out = []
        for (_, places), parts in zip(normal, parted, strict=True):
            ids = np.frombuffer(b"".join([known[p] for p in parts]), np.int32)
            sizes = self.sizes(ids)
            ends = np.cumsum(sizes)
            out.append((ids, places[ends - sizes], places[ends]))
        for part in [p for p in new if len(p) > SHORT_PART]:
            del known[part]
        return out

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_many([data])[0]

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        if self.squeeze or not len(ids) or not self.plain[ids].all():
            return self.by_pieces(ids.tolist())
        sizes = self.shown_bytes[ids]
        ends = np.cumsum(sizes)
        data = self.shown[np.repeat(self.shown_at[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()
        try:
            text = data.decode()
        except UnicodeDecodeError:  # bytes that make no character
            return self.by_pieces(ids.tolist())
        return text[1:] if self.prefix and self.names[ids[0]].startswith(SPACE) else text

    def by_pieces(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        front, eaten = True, False
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(told(bytes(held)))
                held.clear()
            if i is None:
                break
            if eaten or any(out):
                front = False
            name = self.names[i]
            eaten = False
            if self.kinds[i] == CONTROL:
                out.append("")
                continue
            if i == self.unknown:
                out.append(self.unknown_surface)
                continue
            if front and (self.prefix or self.squeeze) and name.startswith(SPACE):
                name, eaten = name[1:], not self.squeeze
            out.append(name.replace(SPACE, " "))
        return "".join(out)


def well_formed(data: bytes, at: int) -> int:
    """The length of the character that begins at a place; 0 where the bytes are malformed."""
    first = data[at]
    size = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    try:
        return len(data[at : at + size].decode().encode()) if size and at + size <= len(data) else 0
    except UnicodeDecodeError:
        return 0


def told(data: bytes) -> str:
    """Bytes as text; each byte that is in no character becomes the replacement sign."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            size = well_formed(data, at)
            out.append(data[at : at + size].decode() if size else REPLACEMENT)
            at += size or 1
        return "".join(out)


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


def encode(df: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): for each row of `df` (doc_id, text) its pieces, and the bytes of the text,
    as UTF-8, that each stands for; no piece for begin or end.

    The ids are those that the model's library gives without sampling. A null text counts as empty and
    has no pieces; texts of any length are coded whole; malformed bytes count as replacement signs. Bytes of a
    character that no piece has are pieces of their own, the last of which has the character's span.
    Rows that repeat, null doc_ids and ties need no care: each row is coded alone. An empty table gives no
    rows; other columns are not read. Models with unused or user-defined pieces, or
    without byte fallback, are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            for part in slices(batch, 1):
                rows = model.encode_many([t or b"" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(lists([r[i] for r in rows]) for i in range(3))], ["doc_id", "ids", "begins", "ends"])

    text = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return text.mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """Adds `decoded` to rows (doc_id, ids): the text that the model's library gives for the ids; of null or no ids an
    empty one. Bytes that make no character become replacement signs. Columns besides doc_id and ids go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                ids = part.column(1)
                texts = [model.decode(ids[i].values.to_numpy(zero_copy_only=False) if ids[i].is_valid else np.zeros(0, np.int32)) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

"""Packing documents into training sequences along a space-filling curve.

Each document becomes token ids and a hashed bag-of-tokens vector; the vector is projected
to a few dimensions and its cell there gets a Hilbert index. Rows are range-sorted by that
index and every range is packed from end to end, so that neighbours in a sequence are alike.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import Scratch, slices

DIMS, BITS, BUCKETS, CACHED_WORDS, SLICE = 4, 8, 4096, 1_000_000, 256
LONGEST_KEPT = 64


OTHER, LETTER, NUMBER, SPACE, ODD = range(5)


def stretches(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all stretches, one after another."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of large strings without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class Kept:
    """The ids of strings in one array; `places` has the numbers of those of up to LONGEST_KEPT characters,
    `cached` and those of one call at most. Longer ones have a number until others are added."""

    def __init__(self, cached: int, dtype: np.dtype):
        self.cached, self.places = cached, {}
        self.ids, self.ends = np.empty(0, dtype), np.zeros(1, np.int64)

    def numbers(self, strings: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each of these strings, which are all different; new ones are encoded."""
        if len(self.places) + len(strings) > self.cached:
            self.places.clear()
        names = listed(strings)
        found = np.fromiter(map(self.places.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            long = pc.utf8_length(strings.take(pa.array(new))).to_numpy() > LONGEST_KEPT
            new = new[np.argsort(long, kind="stable")]
            first, short = len(self.places), len(new) - int(long.sum())
            self.write(first, *encode(strings.take(pa.array(new))))
            found[new] = np.arange(first, first + len(new))
            self.places.update(zip(map(names.__getitem__, new[:short].tolist()), range(first, first + short), strict=True))
        return found

    def write(self, first: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """These ids become those of the numbers from `first` on; room that a long string took is given back."""
        at, n = int(self.ends[first]), first + len(counts)
        if not at + len(ids) <= len(self.ids) <= 4 * (at + len(ids)) + (1 << 20):
            self.ids = np.concatenate([self.ids[:at], np.empty(max(at // 4, len(ids)), self.ids.dtype)])
        if n >= len(self.ends):
            self.ends = np.concatenate([self.ends[: first + 1], np.empty(max(first // 4, len(counts)), np.int64)])
        self.ids[at : at + len(ids)] = ids
        self.ends[first + 1 : n + 1] = at + np.cumsum(counts)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers one after another, and how many each has."""
        starts = self.ends[numbers]
        counts = self.ends[numbers + 1] - starts
        return stretches(self.ids, starts, counts), counts


class WordIds:
    """Ids of texts, and of each word seen.

    Where the tokenizer is one that lower-cases, parts a text by a pattern that drops white space and
    merges the bytes of each part, words stand alone: new ones in Latin letters are parted here at the places
    where that pattern parts them, all at once, and only new parts go through its merges; others are encoded one by one.
    Any other tokenizer encodes whole texts, for white space may count there.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, cached: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kept_words, self.kept_parts = Kept(cached, self.dtype), Kept(cached, self.dtype)
        config = json.loads(self.tokenizer.to_str())
        normal, pre = (config["normalizer"] or {}).get("normalizers", []), (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [x["type"] for x in normal], [x["type"] for x in pre]
        self.by_words = steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and pre[0]["pattern"].get("Regex") == self.PATTERN
        # Characters for which composing, lower case and white space are the same everywhere have a kind, all others are odd:
        # by their only byte, or by both bytes, of which the first is C2 or C3.
        kinds = [ODD] * 256
        for code in (*b"\t\n\r", *range(32, 127), *range(161, 256)):
            category = unicodedata.category(chr(code))
            kinds[code] = SPACE if chr(code).isspace() else {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
        lower = [ord(chr(code).lower()) for code in range(256)]
        self.kinds = np.array([*kinds[:128], *[OTHER] * 64, *[ODD] * 2, *[OTHER] * 2, *[ODD] * 60], np.uint8)
        self.lower = np.array([*lower[:128], *range(128, 256)], np.uint8)
        self.latin_kinds, self.latin_lower = np.array(kinds[128:], np.uint8), np.array([x & 63 | 128 for x in lower[128:]], np.uint8)
        # The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in printable]
        self.alphabet = {x: chr(x) for x in printable} | {x: chr(256 + i) for i, x in enumerate(rest)}

    @property
    def words(self) -> dict[str, int]:
        return self.kept_words.places

    @property
    def parts(self) -> dict[str, int]:
        return self.kept_parts.places

    def flat(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def merge(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.tokenizer.model.tokenize
        spelt = [p if p.isascii() else "".join(map(self.alphabet.__getitem__, p.encode())) for p in listed(parts)]
        return self.flat([[t.id for t in tokenize(p)] for p in spelt])

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.flat([e.ids for e in self.tokenizer.encode_batch(listed(strings), add_special_tokens=False)])

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(words)
        kinds = self.kinds[data]
        latin = np.flatnonzero((data == 0xC2) | (data == 0xC3))
        code = (data[latin] - 0xC2) * 64 + (data[latin + 1] - 128)
        kinds[latin] = kinds[latin + 1] = self.latin_kinds[code]
        bad = np.flatnonzero(kinds == ODD)
        mark = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        odd = np.zeros(len(words), bool)
        odd[np.searchsorted(offsets, np.concatenate([bad, mark]), side="right") - 1] = True
        if not odd.any():
            low = self.lower[data]
            low[latin + 1] = self.latin_lower[code]
            return self.encode_plain(low, kinds, offsets)
        groups, order = [], []
        for chosen, encode in ((~odd, self.encode_words), (odd, self.encode)):
            order.append(np.flatnonzero(chosen))
            if len(order[-1]):
                groups.append(encode(words.filter(pa.array(chosen))))
        ids, counts = (np.concatenate(x) for x in zip(*groups, strict=True))
        back = np.argsort(np.concatenate(order))
        return stretches(ids, (np.cumsum(counts) - counts)[back], counts[back]), counts[back]

    def encode_plain(self, low: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose lower-case bytes these are: parts begin where the kind changes, at each number and at each word."""
        size, n_words = len(low), len(offsets) - 1
        begins, word = np.ones(size + 3, bool), np.zeros(size + 3, bool)
        word[offsets] = word[size:] = True
        begins[1:size] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        begins[:size] &= (low & 0xC0) != 0x80
        begins |= word
        # An apostrophe that begins a part takes s, t, m, d, re, ve or ll of its own word along.
        padded = np.concatenate([low, np.zeros(2, np.uint8)])
        mark = np.flatnonzero((low == ord("'")) & begins[:size] & ~word[1 : size + 1])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, list(b"stmd"))
        pairs = [(one == a) & (two == b) for a, b in (b"re", b"ve", b"ll")]
        long = ~short & np.logical_or.reduce(pairs) & ~word[mark + 2]
        begins[mark[short | long] + 1] = False
        begins[mark[short] + 2] = begins[mark[long] + 3] = True
        starts = np.flatnonzero(begins[:size])
        bounds = np.append(starts, size)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low))
        stays = kinds[starts] != SPACE
        parts = pieces.filter(pa.array(stays)).dictionary_encode()
        numbers = self.kept_parts.numbers(parts.dictionary, self.merge)[parts.indices.to_numpy()]
        ids, counts = self.kept_parts.joined(numbers)
        of = np.searchsorted(offsets, starts[stays], side="right") - 1
        return ids, np.bincount(of, weights=counts, minlength=n_words).astype(np.int64)

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            return self.encode(texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        numbers = self.kept_words.numbers(words.dictionary, self.encode_words)[words.indices.to_numpy()]
        ids, counts = self.kept_words.joined(numbers)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids, np.diff(ends, prepend=0)

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.joined(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts))[:-1]]


@lru_cache(maxsize=2)
def word_ids(path: str, cached: int = CACHED_WORDS) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path, cached)


@lru_cache(maxsize=2)
def projection(buckets: int, dims: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((buckets, dims)).astype(np.float32)


def cells(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Coordinates of unit normal spread -> integers of `bits` bits, evenly filled."""
    share = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(vectors / math.sqrt(2)))
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows), by Skilling's transposition."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert index of each document's hashed, projected bag of tokens."""
    table = projection(BUCKETS, DIMS)
    out = np.zeros((len(ids), DIMS))
    for i, doc in enumerate(ids):
        bag = np.sqrt(np.bincount((doc.astype(np.int64) * 40503) & (BUCKETS - 1), minlength=BUCKETS).astype(np.float32))
        out[i] = bag @ table / max(float(np.sqrt(bag @ bag)), 1.0)
    return hilbert_index(cells(out, BITS), BITS)


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, cached_words: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, ids binary, curve long): ids are little-endian, of the width of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path, cached_words)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found, counts = words.joined(part.column(1))
                ids = np.insert(found, np.cumsum(counts), words.dtype.type(end_id))
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                curve = curve_key(np.split(ids, ends[1:-1]))
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)])
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([part.column(0), coded.cast(pa.binary()), pa.array(curve, pa.int64())], ["doc_id", "ids", "curve"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, curve long")


class Packer:
    """Fills sequences of `size` tokens in the order of the documents."""

    def __init__(self, size: int, first: int):
        self.size, self.next_id, self.open, self.fill, self.done = size, first, [], 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.size - self.fill)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            at += take
            self.fill += take
            if self.fill == self.size:
                self.close(self.size)

    def close(self, length: int) -> None:
        """The first `length` open tokens become a sequence; a piece across that border is cut."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            take = min(len(ids), length - offset)
            if take:
                self.done.append((doc_id, start, ids[:take], total, self.next_id, offset))
            if take < len(ids):
                rest.append((doc_id, start + take, ids[take:], total))
            offset += take
        self.open, self.fill = rest, self.fill - length
        self.next_id += 1

    def finish(self) -> None:
        """What is left becomes sequences whose lengths are powers of two, which need no padding."""
        while self.fill:
            self.close(1 << (self.fill.bit_length() - 1))


def pack(df: DataFrame, tokenizer_path: str, sequence_tokens: int = 2048, end_id: int = 1, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    Reads `doc_id` and `text`, whatever else the table has. A null text counts as empty: its
    document is the end id alone; texts of any length are packed whole. Repeated rows are packed as
    often as they occur, ties on the curve stand in the order of hashed ids; a null doc_id stays
    null. An empty table gives no rows. A worker keeps the ids of about `cached_words`
    words and parts, none of them longer than LONGEST_KEPT characters. Only the last sequence of a range can
    be short, and it is cut into powers of two, so no padding is needed at all.
    """
    spark = df.sparkSession
    width = word_ids(tokenizer_path).dtype
    tokens = Scratch(spark).write(tokenize(df, tokenizer_path, end_id, cached_words), "tokens")
    ties = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id"), F.xxhash64("ids")]
    ranged = tokens.repartitionByRange(F.col("curve"), *ties).sortWithinPartitions(F.col("curve"), *ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(sequence_tokens, TaskContext.get().partitionId() << 32)

        def ready() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                    pa.array([r[5] for r in rows], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for part in slices(batch, 1, SLICE):
                for doc_id, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    packer.add(doc_id, np.frombuffer(ids, width))
                yield ready()
        packer.finish()
        yield ready()

    return ranged.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

"""Word shingles of texts as arrays of hashes, for many texts at once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

U = np.uint64
PIECE, BLANK = 1 << 20, re.compile(r"[\t-\r ]")
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; a worker keeps the longest it has needed."""
    if not _POWERS or len(_POWERS[0]) < n:
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(text: str) -> list[str]:
    """A long text in parts of about PIECE characters that end where a word does."""
    out = []
    while len(text) > PIECE:
        border = BLANK.search(text, PIECE)
        if not border:
            break
        out.append(text[: border.start()])
        text = text[border.end() :]
    return [*out, text]


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text the hashes of its lower-case words; ASCII white space parts words. Long texts are
    hashed a part at a time."""
    if any(len(t) > PIECE for t in texts):
        return [np.concatenate([hashes_of_words([p])[0] for p in pieces(t)]) for t in texts]
    return hashes_of_words(texts)


def hashes_of_words(texts: list[str]) -> list[np.ndarray]:
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    values = _byte_values()[raw]
    up, down = powers(1 << max(12, (len(raw) - 1).bit_length()))
    sums = np.cumsum(values * up[: len(raw)])
    word = values != 0
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:])
    hashes = scramble((sums[ends] - sums[starts - 1]) * down[starts])
    borders = np.searchsorted(starts, np.cumsum([1] + [len(p) + 1 for p in parts]))
    return [hashes[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]


def labelled_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words in text order, each with the number of equal runs before
    it hashed in. A text with fewer words is one run; one without words has none."""
    if not len(words):
        return words
    if len(words) < width:
        words, width = np.array([hash_of(words)], np.uint64), 1
    n = len(words) - width + 1
    runs = words[:n].copy()
    for i in range(1, width):
        runs = runs * U(0xD6E8FEB86659FD93) + words[i : n + i]
    runs = scramble(runs)
    ordered = np.sort(runs)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(runs, kind="stable")
        sorted_ = runs[order]
        first = np.r_[True, sorted_[1:] != sorted_[:-1]]
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        runs = np.where(label > 0, scramble(runs + label * U(0xA0761D6478BD642F)), runs)
    return runs


def hash_of(values: np.ndarray) -> np.uint64:
    """One hash of a sequence."""
    with np.errstate(over="ignore"):
        total = U(len(values))
        for v in values:
            total = total * U(0xD6E8FEB86659FD93) + v
    return scramble(np.array([total], np.uint64))[0]

"""Words are parted and looked up in arrays: the library's ids, and no calls for each word."""

import random
import sys

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rastermill.llm import packing
from rastermill.llm.queries import default_tokenizer

PIECES = ["'", "''", "'s", "'S", "'re", "'LL", "'v", "'d", "s", "e", "Ab", "ÀÉ", "ß", "µ", "ª", "×", "÷", "²", "½", "7", "42", "\u00ad", "¡", "<", "|", "<|", "<|endoftext|>", "_", "#", "..", "\t", "\r", " ", "  ", "\n"]
PIECES += ["\u00a0", "\u0085", "\x0b", "\x1c", "\x00", "\u2019", "漢", "é", "\u0301", "Σ", "\u0130", "\u017f", "\u212a", "\u200b", "😀", "x" * 70]


def test_ids_are_the_librarys():
    dice = random.Random(5)
    texts = ["", " ", "\n\n", "'", "'s", "it's'd", "<", "|", "a< |b"] + ["".join(dice.choices(PIECES, k=dice.randrange(1, 30))) for _ in range(3000)]
    texts += ["a word and " * 10, "<|startoftext|>a", None, "z" * 5000 + "'ll" * 300]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for cached, step in ((1_000_000, 64), (300, 64), (300, 1), (1_000_000, len(texts))):
        words = packing.WordIds(default_tokenizer(), cached)
        assert words.by_words
        for _ in range(2):
            for i in range(0, len(texts), step):
                ids, counts = words.joined(pa.array(texts[i : i + step], pa.string()))
                got = [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]]
                assert got == want[i : i + step], next((t, g, w) for t, g, w in zip(texts[i:], got, want[i:], strict=False) if g != w)


def calls_of(work) -> int:
    count = 0

    def note(frame, event, what):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(note)
    try:
        work()
    finally:
        sys.setprofile(None)
    return count


def test_new_words_of_known_parts_take_no_call_each():
    """440 CPU seconds a GB went largely on six or more calls for each new word."""
    parts = [f"{a}{b}" for a in "bcdfghklmnprstvz" for b in ("a", "e", "i", "o", "u", "é")]
    words = packing.WordIds(default_tokenizer(), 100_000)
    words.ids([" ".join([*parts, *"-.,"])])
    text = " ".join(f"{a}-{b}." for a in parts for b in parts)
    calls = calls_of(lambda: words.ids([text]))
    assert len(words.words) > len(parts) ** 2 and calls < 1000  # 55,000 before, word by word


def test_room_for_long_words_is_given_back():
    words = packing.WordIds(default_tokenizer(), 10_000)
    words.ids(["漢字" * 1_000_000])
    assert len(words.kept_words.ids) >= 2_000_000
    words.ids(["two words"])
    assert len(words.kept_words.ids) < 2_000_000 and set(words.words) == {"two", "words"}

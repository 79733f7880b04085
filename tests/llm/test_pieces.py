"""Sentence pieces against the library that reads the same model."""

import random
import struct

import numpy as np
import pytest

from rastermill.llm import pieces
from rastermill.llm.queries import default_tokenizer, op13_sentencepiece
from tests.llm.helpers import SF, needs_tables, none, odd

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = default_tokenizer("piece_bpe_32k.model")
LETTERS = ["a", "b", " ", "  ", "\n", "\t", "▁", "是", "的", "é", "é", "ñ", "　", "😀", "\0", "<s>", "<0x0A>", "the ", " of", "'", "12", "ﬁ", " ", "​"]


def double_array(rules: dict[bytes, int]) -> bytes:
    """A trie of byte strings and values in the compiled form."""
    units: dict[int, int] = {}

    def place(node: int, head: int, keys: list[bytes], depth: int) -> None:
        labels = sorted({k[depth] for k in keys if len(k) > depth})
        leaf = any(len(k) == depth for k in keys)
        base = next(b for b in range(1, 1 << 20) if all(b ^ c not in units for c in labels) and (not leaf or b not in units))
        units[node] = head | (node ^ base) << 10 | leaf << 8
        if leaf:
            units[base] = 1 << 31 | rules[next(k for k in keys if len(k) == depth)]
        units.update({base ^ c: c for c in labels})
        for c in labels:
            place(base ^ c, c, [k for k in keys if len(k) > depth and k[depth] == c], depth + 1)

    units[0] = 0
    place(0, 0, sorted(rules), 0)
    return np.array([units.get(i, 0) for i in range(-(-(max(units) + 1) // 256) * 256)], "<u4").tobytes()


def field(number: int, value: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The model with a compiled character map, and white space squeezed or not."""
    results, rules = b"", {}
    for source, result in {"ﬁ": "fi", "é": "é", "　": " ", " ": " ", "\t": " ", "\n": " ", "​": "", "ab": "b", "abb": "a a", "是的": "是"}.items():
        rules[source.encode()] = len(results)
        results += result.encode() + b"\0"
    trie = double_array(rules)
    out = {}
    for squeeze in (0, 1):
        with open(MODEL, "rb") as file:
            data = file.read() + field(3, field(2, struct.pack("<I", len(trie)) + trie + results) + field(4, squeeze))
        path = tmp_path_factory.mktemp("models") / f"{squeeze}.model"
        path.write_bytes(data)
        out[squeeze] = str(path)
    return out


def same_as_library(path: str, rounds: int) -> None:
    mine, library, rnd = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    texts = ["", " ", "   ", "a", *("".join(rnd.choices(LETTERS, k=rnd.randint(0, 60))) for _ in range(rounds))]
    texts += ["word " * 500, "x" * 3000, "是的" * 1500]
    for text, (ids, begins, ends) in zip(texts, mine.encode_many([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text), text
        told = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == told, text
        assert mine.decode(ids) == library.decode(ids.tolist()), text
    for _ in range(rounds):
        ids = [rnd.randrange(0, 32000) if rnd.random() < 0.5 else rnd.randrange(0, 259) for _ in range(rnd.randint(0, 12))]
        assert mine.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_ids_spans_and_texts():
    same_as_library(MODEL, 800)


@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map(mapped, squeeze):
    same_as_library(mapped[squeeze], 400)


def test_spans_are_of_the_source(mapped):
    text = "  é ﬁ　x ".encode()
    ids, begins, ends = pieces.Model(mapped[1]).encode(text)
    assert [text[b:e] for b, e in zip(begins, ends, strict=True)][-1].strip() and ends.max() <= len(text) and (np.diff(begins) >= 0).all()


def test_malformed_bytes_and_cache():
    model = pieces.Model(MODEL)
    ids, _, ends = model.encode(b"ok \xff\xe6\x98 x")
    assert ids.tolist() == model.encode("ok ��� x".encode())[0].tolist() and ends[-1] == 8
    known = len(model.young)
    assert len(model.encode(("漢字" * 500_000).encode())[0]) >= 1_000_000 and len(model.young) == known  # a long part is not kept


def test_slow_and_quick_merges_agree():
    model, rnd = pieces.Model(MODEL), random.Random(2)
    parts = ["".join(rnd.choices("abehnorst▁.,'是é😀", k=rnd.randint(1, 60))) for _ in range(500)]
    assert model.code_many(parts) == [model.code(p) for p in parts]


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    (tmp_path / "unigram.model").write_bytes(data + field(2, field(3, 1)))
    with pytest.raises(ValueError, match="merged pairs"):
        pieces.Model(str(tmp_path / "unigram.model"))


def test_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.decode(pieces.encode(odd(spark), MODEL), MODEL).collect()
    expected = [(r["doc_id"], r["text"] or "") for r in odd(spark).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in rows), key=key) == sorted(((d, library.encode(t), library.decode(library.encode(t))) for d, t in expected), key=key)
    assert pieces.decode(pieces.encode(none(spark), MODEL), MODEL).count() == 0


@needs_tables
def test_query(spark):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))

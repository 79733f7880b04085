"""Slices of batches, the shared folder, long texts."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from rastermill.llm import common, shingles


def test_slices_hold_all_rows_and_few_bytes():
    texts = ["a", None, "x" * (3 << 20), "", "é" * 700_000, "é" * 700_000, "b"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(common.slices(batch, 1, 4))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    for p in parts:
        sizes = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert p.num_rows == 1 or (p.num_rows <= 4 and sum(sizes) <= common.SLICE_BYTES)
    assert list(common.slices(batch.slice(0, 0), 1)) == []


@pytest.mark.parametrize("master, fails", [("local[4]", False), ("local-cluster[2,1,1024]", True), ("yarn", True), ("spark://host:7077", True)])
def test_a_cluster_must_name_its_folder(master, fails):
    held = {}
    conf = SimpleNamespace(get=lambda key, default=None: held.get(key, default), set=held.__setitem__)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session)
        held["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert common.shared_folder(session) == (held["spark.checkpoint.dir"].rstrip("/"))


def test_long_texts_have_the_hashes_of_their_words(monkeypatch):
    words = [f"w{i}é" for i in range(3000)]
    text = " \n".join(words)
    whole = shingles.hashes_of_words([text])[0]
    monkeypatch.setattr(shingles, "PIECE", 500)
    parts = shingles.word_hashes([text, "short one", "x" * 2000])
    assert np.array_equal(parts[0], whole) and len(parts[0]) == 3000 and len(parts[1]) == 2 and len(parts[2]) == 1

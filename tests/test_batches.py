"""Streams coded many at a time are those coded one by one."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rastermill.operators import entropy as E

PAIRS = st.lists(st.lists(st.integers(1, 2048).flatmap(lambda m: st.tuples(st.integers(0, m - 1), st.just(m))), max_size=40), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(PAIRS)
def test_batches_match_single_streams(rows):
    values, bounds = ([np.array([p[i] for p in row], np.int64) for row in rows] for i in (0, 1))
    streams = E.encode_batch(values, bounds)
    assert streams == [E.encode(v.tolist(), b.tolist()) for v, b in zip(values, bounds, strict=True)]
    assert E.decode_batch(streams, bounds) == [v.tolist() for v in values]


def test_foreign_streams_are_read_alike():
    rng = np.random.default_rng(1)
    streams = [rng.bytes(int(n)) for n in rng.integers(0, 12, 200)]
    bounds = [rng.integers(1, 300, int(n)) for n in rng.integers(0, 20, 200)]
    plain = [[reader.number(int(m)) for m in b] for reader, b in ((E.Reader(s), b) for s, b in zip(streams, bounds, strict=True))]
    assert E.decode_batch(streams, bounds) == plain


def test_long_streams_stand_alone():
    values, bounds = np.arange(E.LONG + 5) % 7, np.full(E.LONG + 5, 7)
    found = E.in_batches([3, len(values), 2], lambda part: [("short", i) for i in part], lambda i: ("alone", i))
    assert found == [("short", 0), ("alone", 1), ("short", 2)]
    reader = E.Reader(E.encode(values.tolist(), bounds.tolist()))
    assert [reader.number(7) for _ in values] == values.tolist()

"""Top-k with vectors whose products pass the bound of exact 64-bit arithmetic."""

import math

import numpy as np

from rastermill.llm import pivot_index


def test_long_vectors_are_searched_and_found(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1400, 6)).astype(np.float32)
    data[7::50] *= np.float32(1e6)
    data[9::90] *= np.float32(1e30)
    data[100] *= np.float32(3e5)
    data[200] *= np.float32(1e25)
    data[300] = [1e36, 1, 0, 0, 0, 0]
    data[301:304] = [[1e36, 3, 0, 0, 0, 0], [1e36, 2, 0, 0, 0, 0], [1e36, 3, 0, 0, 0, 0]]  # told apart by exact sums only
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    whole = [[math.floor(float(x) * 1024) for x in v] for v in data]
    want = []
    for q in range(0, 1400, 100):
        scores = [(-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q]
        want += [(q, rank + 1, i, -s if abs(s) < 2**63 else None) for rank, (s, i) in enumerate(sorted(scores)[:10])]
    got = pivot_index.top_k(pivot_index.integer_vectors(rows), "vec_id % 100 = 0", 10).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want

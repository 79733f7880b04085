"""Connected components of long chains, whose nodes are in random order along them."""

import random

from rastermill.llm.common import Scratch, connected_components


def components(spark, links):
    edges = spark.createDataFrame(links, "u long, v long")
    return {r["node"]: r["component"] for r in connected_components(spark, edges, Scratch(spark), "test").collect()}


def test_shuffled_chains(spark):
    names = list(range(1400))
    random.Random(5).shuffle(names)
    long, short, star = names[:1000], names[1000:1300], names[1300:]
    links = [*zip(long[1:], long, strict=False), *zip(short, short[1:], strict=False), *((star[0], s) for s in star[1:])]
    assert components(spark, links) == {n: min(part) for part in (long, short, star) for n in part}

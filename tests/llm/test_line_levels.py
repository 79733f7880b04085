"""Line de-duplication as registered merges runs while batches still come."""

from collections import Counter

from rastermill.llm import line_dedup, queries
from tests.llm.helpers import SF, needs_tables


def test_later_batches_meet_frequent_lines(spark, monkeypatch):
    known, levels, add = [], [], line_dedup.LineStore.add

    def watched(store, batch):
        known.append(bool(store.frequent))
        add(store, batch)
        levels.append(len(store.levels))

    monkeypatch.setattr(line_dedup.LineStore, "add", watched)
    texts = [f"Often\nby {i % 3}\nin {i % 9}\nfew {i % 20}\nown {i}" for i in range(120)]
    counts = Counter(line for t in texts for line in t.split("\n"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_frequent_lines(rows, 10).collect()}
    assert got == {i: "\n".join(line for line in t.split("\n") if counts[line] < 10) for i, t in enumerate(texts)}
    assert any(known) and max(levels) >= 3


@needs_tables
def test_the_registered_query_anti_joins(spark, monkeypatch):
    """Later batches lose the lines known to be frequent, and neither that nor merging shuffles runs."""
    arrived, stored, plans, add, put = [], [], [], line_dedup.LineStore.add, line_dedup.LineStore.put

    def watched(store, batch):
        arrived.append((batch.count(), bool(store.frequent)))
        stored.append([])
        add(store, batch)

    def kept(store, run):
        name = put(store, run)
        stored[-1].append(store.read(name).count())
        if "Join" in (plan := run._jdf.queryExecution().executedPlan().toString()):
            plans.append(plan)
        return name

    monkeypatch.setattr(line_dedup.LineStore, "add", watched)
    monkeypatch.setattr(line_dedup.LineStore, "put", kept)
    queries.op6_line_dedup(spark, SF).count()
    later = [(n, counts) for (n, known), counts in zip(arrived, stored, strict=True) if known]
    assert later and all(counts[0] == n and counts[1] < n for n, counts in later)
    assert plans and not any("Exchange" in p for p in plans)

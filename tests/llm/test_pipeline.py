import collections

from pyspark.sql import functions as F

import corpus_pipeline
from rastermill.llm.common import Scratch
from tests.llm.helpers import SF, needs_tables, none, odd
from tests.llm.test_text_operators import check_pack, true_classes


@needs_tables
def test_each_stage_on_its_own_input(spark):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    scratch = Scratch(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = columns or docs.columns
        out = scratch.write(stage(spark, docs, SF), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns
        docs = out
    before, after = seen["language_id"]
    assert after.exceptAll(before).count() == 0 and after.count() >= 0.9 * before.count()
    before, after = seen["line_dedup"]
    lines = collections.Counter(k for r in before.collect() for k in {x.strip().lower() for x in r["text"].split("\n")})
    for r in after.collect():
        assert all(lines[x.strip().lower()] < 10 for x in r["text"].split("\n") if x.strip())
    before, after = seen["near_dedup"]
    classes = true_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(classes.values()))
    before, after = seen["mixing"]
    assert after.select("doc_id", "text").distinct().exceptAll(before.select("doc_id", "text")).count() == 0
    before, after = seen["packing"]
    check_pack(before, after.collect())
    assert corpus_pipeline.run(spark, SF).select(F.sum("length")).first()[0] == after.select(F.sum("length")).first()[0]


def test_stages_stand_odd_and_empty_tables(spark):
    for docs in (odd(spark).select("doc_id", "text", "lang", "source", "n_chars"), none(spark).select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()

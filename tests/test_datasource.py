"""Files written and read as data sources; a failing task leaves none."""

import os

import pytest
from pyspark.sql import functions as F

from rastermill import cli
from rastermill.functions import dimensions
from rastermill.plans import queries as Q
from rastermill.sources import datasource, files

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@needs_tables
def test_images_there_and_back(spark, tmp_path):
    datasource.register(spark)
    pixels = Q.emb(spark, SF)
    images = files.write_png(pixels).select(F.concat(F.lit("image"), F.col("image_id")).alias("name"), "data")
    images.write.format("png").mode("append").save(str(tmp_path))
    read = spark.read.format("png").load(str(tmp_path))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, images.collect()))
    shown = files.read_png(spark, f"{tmp_path}/*.png").withColumn("image_id", F.regexp_extract("path", "image([0-9]+).png", 1).cast("long"))
    assert shown.select("image_id", "y", "x", "r", "g", "b").exceptAll(pixels).count() == 0 and shown.count() == pixels.count()
    assert not [n for n in os.listdir(tmp_path) if not n.endswith(".png")]


def test_streams_and_failures(spark, tmp_path):
    datasource.register(spark)
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("s"), F.col("id")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("data"))
    broken = rows.withColumn("data", F.when(F.col("name") == "s35", F.raise_error("broken")).otherwise(F.col("data")).cast("binary"))
    for bad in (broken, rows.withColumn("name", F.lit("same")), rows.withColumn("data", F.lit(None).cast("binary"))):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format("rim").mode("append").save(str(tmp_path))
        assert not [n for n in os.listdir(tmp_path) if not n.startswith(".writing")] and spark.read.format("rim").load(str(tmp_path)).count() == 0
    rows.write.format("rim").mode("append").save(str(tmp_path))
    assert len([n for n in os.listdir(tmp_path) if n.endswith(".rim")]) == 40 and {(r["name"], bytes(r["data"])) for r in spark.read.format("rim").load(str(tmp_path)).collect()} == {(f"s{i}", str(i).encode()) for i in range(40)}
    rows.limit(3).write.format("rim").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("rim").load(str(tmp_path)).count() == 3


def test_reading_deals_files_out(tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.rim").write_bytes(b"x" * (10 if i else 90))
    (tmp_path / "other.png").write_bytes(b"y")
    monkeypatch.setattr(datasource, "PART_BYTES", 100)
    monkeypatch.setattr(datasource, "PART_FILES", 4)
    parts = datasource.Reader({"path": str(tmp_path)}, ".rim").partitions()
    assert [len(p.paths) for p in parts] == [2, 4, 1]


def test_help_and_all_variants(spark, capsys):
    assert cli.main(["-h"]) == 0 and "-p all" in capsys.readouterr().out
    assert cli.variants_of(spark, "all").count() == dimensions.all_variants(spark).count() == 31_500

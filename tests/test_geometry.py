"""Splits by lines, on small regions with known parts."""

from pyspark.sql import functions as F

from rastermill.functions import dimensions as D
from rastermill.operators import geometry as G


def lines_of(spark, spans, angle, limit):
    turn = D.angles(spark).where(F.col("angle") == angle).select("sn", "cs").first()
    cuts = spark.createDataFrame(spans, "y long, x0 long, x1 long").withColumns({"id": F.lit(0), "sn": F.lit(turn["sn"]), "cs": F.lit(turn["cs"]), "line_limit": F.lit(limit)})
    reach = G.distance_range(cuts, ["id"]).withColumn("line", F.explode(F.expr("sequence(0L, num_lines - 1)"))).withColumn("d", G.line_distance(F.col("line")))
    return G.split_spans(cuts.join(reach.select("id", "line", "d"), "id")).select("line", "side", "y", "x0", "x1").collect()


def test_across_a_row(spark):
    parts = lines_of(spark, [(0, 0, 4)], 256, 63)
    assert sorted((r["line"], r["x0"], r["x1"]) for r in parts if r["side"] == "L") == [(0, 1, 4), (1, 2, 4), (2, 3, 4)]
    assert sorted((r["line"], r["x0"], r["x1"]) for r in parts if r["side"] == "R") == [(0, 0, 1), (1, 0, 2), (2, 0, 3)]


def test_down_a_column(spark):
    parts = lines_of(spark, [(y, 0, 1) for y in range(4)], 0, 63)
    for line, right in enumerate((1, 2, 3)):
        rows = [r for r in parts if r["line"] == line]
        assert sum(r["side"] == "R" for r in rows) == right and sum(r["side"] == "L" for r in rows) == 4 - right


def test_parts_cover_the_region(spark):
    spans = spark.range(16).select(F.col("id").alias("y"), F.lit(0).cast("long").alias("x0"), F.lit(64).cast("long").alias("x1"))
    cuts = spans.join(D.angles(spark).where("angle % 37 = 0").select("angle", "sn", "cs")).withColumn("d", F.col("sn") * 20 + F.col("cs") * 5)
    sizes = G.split_spans(cuts).groupBy("angle").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))
    assert sizes.where("n <> 1024").count() == 0

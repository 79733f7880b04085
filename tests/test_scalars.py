"""Fixed tables, check sums and parsing, against published values."""

import math

from pyspark.sql import functions as F

from rastermill.functions import columns as C
from rastermill.functions import dimensions as D
from rastermill.operators import entropy as E


def crc_of(spark, values):
    return spark.createDataFrame([(list(values),)], "b array<int>").select(C.crc64(F.col("b")).alias("c")).first()["c"]


def test_crc64(spark):
    assert crc_of(spark, range(97, 107)) == "32093A2ECD5773F4"
    assert crc_of(spark, []) == "0" * 16


def test_angle_tables(spark):
    rows = D.angles(spark).orderBy("angle").collect()
    assert crc_of(spark, [r["sn"] & 255 for r in rows]) == "9486473C3841E28F"
    assert crc_of(spark, [r["cs"] & 255 for r in rows]) == "A32700985A177AE9"


def test_log2(spark):
    assert all(abs(r["v"] - math.log2(r["n"])) <= 2.2e-7 for r in D.log2_table(spark).where("n < 64").collect())


def test_size_codes_and_header_tax(spark):
    rows = spark.range(9, 2049).select("id", C.size_bits(F.col("id")).alias("bits"), E.entropy_bits(E.entries(*E.size_entries(F.col("id")))).alias("coded"))
    assert rows.where("bits <> coded").count() == 0
    head = E.header_entries(F.lit(9), F.lit(9), F.lit(0), F.lit(1), F.lit(0))
    row = spark.range(1).select(E.entropy_bits(head).alias("a"), C.image_tax(F.lit(9), F.lit(9)).alias("b")).first()
    assert abs(row["a"] - row["b"]) < 1e-6


def test_codes(spark):
    quants = [r["quant"] for r in D.color_codes(spark).orderBy("code").collect()]
    assert quants[:17] == [5, 6, 7, 8, 9, 11, 13, 15, 17, 21, 25, 29, 33, 41, 49, 57, 65] and quants[17:] == [0] * 32
    parts = D.partition_codes(spark).withColumn("joined", C.join_code(*(F.col(f"f{i}") for i in range(1, 5))))
    assert parts.where("joined <> code").count() == 0


def test_variants(spark):
    rows = spark.createDataFrame([("D7:40:3,0:*:1",), ("*:1:1",), ("1f4:1:1",), ("1:0:1",), ("x",), (None,)], "variants string")
    got = [(r["partition_code"], r["line_limit"], r["color_options"]) for r in D.parse_variants(rows).collect()]
    assert (0xD7, 6, 3) in got and len(got) == 1 + 63
    packed = D.unpack_variants(D.pack_variants(D.all_variants(spark)).select("variant_id", "record"))
    assert packed.exceptAll(D.pack_variants(D.all_variants(spark)).select(packed.columns)).count() == 0

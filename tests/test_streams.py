"""The entropy coder, decoding, and whole images."""

import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastermill.operators import decode as D
from rastermill.operators import encode as N
from rastermill.operators import entropy as E
from rastermill.operators import rasters as R
from rastermill.sources import files

# Published streams.
NUMBERS = ([13, *range(42, 52 + 1)], [63] + [256] * 11)
CODED = [-78, -15, 81, -45, -48, -46, -47, 51, 48, 50, 49, -77]
CROSS = [50, -103, -66, 110, -65, 119, 0, -128, -1, -1, -1, 110, 127, -46, 48, -77, 28, 6, -19, 111, -22, 121, 77]


OLDER_CROSS = [131, 137, 248, 39, 89, 113, 0, 128, 255, 255, 255, 62, 75, 106, 228, 181, 70, 203, 199, 204, 27, 8, 22]


def test_known_stream():
    data = np.array(CODED, np.int8).tobytes()
    assert E.encode(*NUMBERS) == data
    reader = E.Reader(data)
    assert [reader.number(m) for m in NUMBERS[1]] == NUMBERS[0]


def test_random_streams():
    state = 42
    for items in (10, 30, 50, 70, 90):
        for _ in range(20):
            values, bounds = [], []
            for _ in range(items):
                state = state * 16807 % (2**31 - 1)
                bounds.append(1 + state % 42)
                state = state * 16807 % (2**31 - 1)
                values.append(state % bounds[-1])
            reader = E.Reader(E.encode(values, bounds))
            assert [reader.number(m) for m in bounds] == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048).flatmap(lambda m: st.tuples(st.integers(0, m - 1), st.just(m))), max_size=60))
def test_any_stream(pairs):
    reader = E.Reader(E.encode([v for v, _ in pairs], [m for _, m in pairs]))
    assert [reader.number(m) for _, m in pairs] == [v for v, _ in pairs]


def test_decodes_the_cross(spark):
    rows = spark.createDataFrame([(0, bytearray(np.array(CROSS, np.int8).tobytes()))], "image_id long, data binary")
    head = D.read_headers(rows).first()
    assert (head["width"], head["height"], head["partition_code"], head["line_limit"], head["color"]) == (20, 20, 215, 7, 18)
    got = D.decode_images(rows)
    assert got.count() == 400 and got.exceptAll(R.cross(spark).select(got.columns)).count() == 0


def test_decodes_the_older_dialect(spark):
    rows = spark.createDataFrame([(0, bytearray(OLDER_CROSS))], "image_id long, data binary")
    got = D.decode_images(rows, older=True)
    assert got.count() == 400 and got.exceptAll(R.cross(spark).select(got.columns)).count() == 0


def test_short_and_empty_streams(spark):
    rows = spark.createDataFrame([(0, bytearray(b"")), (1, bytearray(b"\xff\x01")), (2, None)], "image_id long, data binary")
    D.decode_images(rows).collect()


def test_encodes_the_cross_and_reports_others(spark):
    flat = spark.range(100).select(F.lit(1).cast("long").alias("image_id"), F.expr("id div 10").alias("y"), (F.col("id") % 10).alias("x"), *(F.lit(7).cast("long").alias(c) for c in "rgb"))
    small = flat.where("x < 4 and y < 4").withColumn("image_id", F.lit(2).cast("long"))
    variants = spark.createDataFrame([(0, 0xD7, 6, 1 << 18)], "variant_id int, partition_code int, line_limit int, color_options long")
    got = {r["image_id"]: r for r in N.encode_images(R.cross(spark).unionByName(flat).unionByName(small), variants, 24).collect()}
    assert got[0]["status"] == "ok" and got[0]["mse"] <= 1e-3 and len(got[0]["data"]) <= 23
    assert got[1]["status"] == "flat" and got[1]["data"] is None and got[2]["status"] == "size"
    back = D.decode_images(spark.createDataFrame([(0, got[0]["data"])], "image_id long, data binary"))
    assert back.exceptAll(R.cross(spark).select(back.columns)).count() == 0


def test_png_files(spark, tmp_path):
    made = files.write_png(R.cross(spark))
    written = files.write_files(spark, made.select(F.lit("cross").alias("name"), "data"), str(tmp_path), ".png")
    assert written.first()["written"] and os.path.exists(tmp_path / "cross.png")
    back = files.read_png(spark, str(tmp_path / "cross.png")).select("y", "x", "r", "g", "b")
    assert back.count() == 400 and back.exceptAll(R.cross(spark).select(back.columns)).count() == 0

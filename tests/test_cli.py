"""The command line and the sources behind it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill import cli
from rastermill.functions import dimensions as D
from rastermill.operators import decode, encode
from rastermill.operators import rasters as R
from rastermill.sources import files


def test_options_hold_for_the_files_after_them():
    runs, jobs = cli.parse(["-j4", "-t", "40", "-e", "a.png", "b.png", "-pD7:*:1", "-r", "c.png", "-d", "-o", "out", "d.rim"])
    assert jobs == 4 and [(j.encode, j.roundtrip, j.target, j.params[:2], j.folder, p) for j, p in runs] == [
        (True, False, 40, "D7", ".", ["a.png", "b.png"]),
        (True, True, 40, "D7", ".", ["c.png"]),
        (False, True, 40, "D7", "out", ["d.rim"]),
    ]
    for wrong in (["-t15", "a"], ["-j0", "a"], ["-x", "a"], ["-t"]):
        with pytest.raises(cli.UsageError):
            cli.parse(wrong)


def test_hexadecimal_numbers_of_sixteen_digits(spark):
    rows = spark.createDataFrame([("D7:7fffffffffffffff:1",), ("D7:0000000000000040:0000000000000003",), ("D7:ffffffffffffffff:1",), ("D7:1:10000000000000000",), ("D7:1:ffffffffffffffff",)], "variants string")
    got = D.parse_variants(rows).groupBy("variants").count().collect()
    assert {r["variants"]: r["count"] for r in got} == {"D7:7fffffffffffffff:1": 63, "D7:0000000000000040:0000000000000003": 1}
    wrong = {r["variants"] for r in D.variant_parts(rows).where("_wrong IS NOT NULL").collect()}
    assert wrong == {r["variants"] for r in rows.collect()} - {r["variants"] for r in got}


def test_parts_of_one_code_and_line_are_variants_of_their_own(spark):
    text = lambda t: spark.createDataFrame([(t,)], "variants string")
    both = D.numbered_variants(text("D7:40:40000,D7:40:10"))
    assert [tuple(r) for r in both.orderBy("variant_id").select("variant_id", "line_limit", "color_options").collect()] == [(6, 6, 1 << 18), (69, 6, 1 << 4)]
    alone = encode.encode_images(R.cross(spark), D.numbered_variants(text("D7:40:40000")), 24).first()
    row = encode.encode_images(R.cross(spark), both, 24).first()
    assert (row["mse"], bytes(row["data"]), row["color"]) == (alone["mse"], bytes(alone["data"]), 18) and row["mse"] >= 0 and len(row["data"]) <= 24
    with pytest.raises(ValueError, match="repeats"):
        encode.encode_images(R.cross(spark), both.withColumn("variant_id", F.lit(1)), 24)


def test_files_there_and_back(spark, tmp_path):
    files.write_files(spark, files.write_png(R.cross(spark)).select(F.lit("cross").alias("name"), "data"), str(tmp_path), ".png").collect()
    assert cli.main(["-t24", "-pD7:40:40000", "-o", str(tmp_path), "-r", "-e", str(tmp_path / "cross.png")]) == 0
    back = files.read_png(spark, str(tmp_path / "cross.png.png")).select("y", "x", "r", "g", "b")
    assert back.exceptAll(R.cross(spark).select(back.columns)).count() == 0
    assert (tmp_path / "cross.png.rim").stat().st_size <= 24
    assert cli.main(["-pD7:40", "-e", str(tmp_path / "cross.png")]) == 1
    twice = spark.createDataFrame([("a", bytearray(b"1")), ("a", bytearray(b"2")), ("b", bytearray(b"3"))], "name string, data binary")
    assert sorted(map(tuple, files.write_files(spark, twice, str(tmp_path), ".x").collect())) == [("a", False), ("a", False), ("b", True)]


def test_rgba_rows(spark):
    row = files.rgba_rows(R.cross(spark)).first()
    cells = np.frombuffer(bytes(row["data"]), np.uint8).reshape(20, 20, 4)
    assert (row["width"], row["height"]) == (20, 20) and (cells[:, :, 3] == 255).all() and (cells[:, :, 0] == 255).all() and sorted(set(cells[:, :, 1].ravel())) == [0, 255]


def test_hostile_sides_are_refused():
    from rastermill.operators.entropy import encode as coded

    # The older dialect: octal digits with a sign that more follow, here up to a side of millions.
    values = [v for _ in range(8) for v in (7, 1)]
    bounds = [8, 2] * 8
    head, leaves = decode.parse(coded(values, bounds), older=True)
    assert leaves is None and max(head.width, head.height) > 2048


def test_result_records(spark):
    rows = spark.createDataFrame([(0.5, bytearray(b"abc")), (None, None)], "mse double, data binary")
    got = [r["record"] for r in rows.select(encode.result_record("mse", "data").alias("record")).collect()]
    assert bytes(got[0]) == b"\3\0\0\0" + np.float32(0.5).tobytes() + b"abc" and got[1] is None

"""Reading and writing images and streams as files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, data): whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def write_streams(df: DataFrame, path: str) -> None:
    """(image_id, data, ...) as Parquet, a stream a row."""
    df.write.mode("overwrite").parquet(path)


def write_files(spark: SparkSession, df: DataFrame, folder: str, suffix: str) -> DataFrame:
    """(name, data) -> one file a row in `folder`, written by the tasks; gives (name, written). `folder` is a URI
    of a store that all executors reach (hdfs, s3, gs), or a path on a disk that they share. Rows whose
    names repeat are not written, for one would take the other's place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            done = []
            for name, data, times in zip(batch["name"], batch["data"], batch["times"], strict=True):
                try:
                    if times == 1:
                        store.create_dir(base, recursive=True)
                        with store.open_output_stream(f"{base}/{name}{suffix}") as f:
                            f.write(bytes(data))
                    done.append(times == 1)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"name": batch["name"].astype(object), "written": done})

    rows = df.select(F.col("name").cast("string"), "data")
    counted = rows.join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("times")), "name")
    return counted.mapInPandas(run, "name string, written boolean")


def read_png(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, width, height, y, x, r, g, b) of all PNG images with three colour channels."""
    images = spark.read.format("image").option("dropInvalid", True).load(list(paths)).select("image.*")
    images = images.where("nChannels IN (3, 4)")
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    rows = images.select("origin", "width", "height", "nChannels", "data", at)
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * F.col("nChannels") + k + 1, F.lit(1))), 16, 10).cast("long")
    # Spark's image source keeps blue first.
    return rows.select(F.col("origin").alias("path"), F.col("width").cast("long"), F.col("height").cast("long"), F.expr("i div width").alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def png_bytes(width: int, height: int, rgb: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = rgb.reshape(height, 3 * width)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def to_png(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
    """Sizes and interleaved RGB bytes -> PNG files."""
    return pd.Series([png_bytes(int(w), int(h), np.frombuffer(bytes(d), np.uint8)) for w, h, d in zip(width, height, rgb, strict=True)])


def write_png(pixels: DataFrame) -> DataFrame:
    """Pixels -> (image_id, data): each image, of at most 2048 by 2048 pixels, as a PNG file."""
    code = F.lpad(F.hex(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")), 6, "0")
    rows = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", code.alias("code")))).alias("row"))
    rows = rows.select("image_id", "y", F.size("row").alias("width"), F.array_join(F.transform("row", lambda p: p["code"]), "").alias("line"))
    whole = rows.groupBy("image_id").agg(F.max("width").alias("width"), F.count(F.lit(1)).alias("height"), F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    data = F.unhex(F.array_join(F.transform("lines", lambda p: p["line"]), ""))
    return whole.select("image_id", to_png("width", "height", data).alias("data"))


def rgba_rows(pixels: DataFrame) -> DataFrame:
    """Pixels -> (image_id, width, height, data): each image as interleaved RGBA bytes, alpha 255."""
    code = F.concat(F.lpad(F.hex(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")), 6, "0"), F.lit("FF"))
    rows = pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", code.alias("code")))).alias("row"))
    rows = rows.select("image_id", "y", F.size("row").alias("width"), F.array_join(F.transform("row", lambda p: p["code"]), "").alias("line"))
    whole = rows.groupBy("image_id").agg(F.max("width").cast("long").alias("width"), F.count(F.lit(1)).alias("height"), F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    return whole.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("lines", lambda p: p["line"]), "")).alias("data"))

"""Dimension tables of fixed size, and variants."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions import columns as C
from rastermill.functions import constants as K

# Sines and cosines of the angles as arrays, for kernels.
TURN = np.arange(K.ANGLES) * (math.pi / K.ANGLES)
SIN = np.floor(np.sin(TURN) * K.SCALE + 0.5).astype(np.int64)
COS = np.floor(np.cos(TURN) * K.SCALE + 0.5).astype(np.int64)


def angles(spark: SparkSession) -> DataFrame:
    """(angle, sn, cs, inv_sin, minus_cot): 512 rows."""
    turn = F.col("angle") * (math.pi / K.ANGLES)
    rows = spark.range(K.ANGLES).select(F.col("id").cast("int").alias("angle"))
    rows = rows.select("angle", F.floor(F.sin(turn) * K.SCALE + 0.5).alias("sn"), F.floor(F.cos(turn) * K.SCALE + 0.5).alias("cs"))
    flat = F.col("angle") == 0
    return rows.select("angle", "sn", "cs", F.when(flat, 0.0).otherwise(1.0 / F.col("sn")).alias("inv_sin"), F.when(flat, 0.0).otherwise(-F.col("cs") / F.col("sn")).alias("minus_cot"))


def log2_table(spark: SparkSession) -> DataFrame:
    """(n, v): 1..65."""
    return spark.range(1, 66).select(F.col("id").cast("int").alias("n"), F.log2("id").cast("float").alias("v"))


def color_codes(spark: SparkSession) -> DataFrame:
    """(code, quant, palette): 49 rows."""
    code = F.col("id")
    return spark.range(K.COLOR_CODES).select(code.cast("int").alias("code"), C.color_quant(code).alias("quant"), C.palette_size(code).alias("palette"))


def partition_codes(spark: SparkSession) -> DataFrame:
    """(code, f1, f2, f3, f4): 500 rows."""
    f1, f2, f3, f4 = C.split_code(F.col("id"))
    return spark.range(K.PARTITION_CODES).select(F.col("id").cast("int").alias("code"), f1.alias("f1"), f2.alias("f2"), f3.alias("f3"), f4.alias("f4"))


def all_variants(spark: SparkSession) -> DataFrame:
    """(variant_id, partition_code, line_limit, color_options): every partition and line limit, all colours."""
    n = K.LINE_LIMITS
    return spark.range(K.PARTITION_CODES * n).select(F.col("id").cast("int").alias("variant_id"), C.div(F.col("id"), n).cast("int").alias("partition_code"), (F.col("id") % n).cast("int").alias("line_limit"), F.lit((1 << K.COLOR_CODES) - 1).alias("color_options"))


def variant_parts(df: DataFrame, column: str = "variants") -> DataFrame:
    """`P:L:C,...` in hexadecimal -> a row for each part, in order: _at, _part, partition_code, color_options,
    _lines (a set of line limits) and _wrong: null, or why the part can't be used. `*` stands for all line
    limits or colours; bits beyond the last limit or colour are wrong."""
    parts = df.select(*df.columns, F.posexplode(F.split(F.col(column), ",")).alias("_at", "_part"))
    fields = F.split("_part", ":")
    field = lambda i: F.get(fields, F.lit(i))
    every = lambda n: F.lit((1 << n) - 1).cast("long")
    rows = parts.withColumns({
        "partition_code": C.parse_hex(field(0), F.lit(None).cast("long")),
        "_lines": C.parse_hex(field(1), every(K.LINE_LIMITS)),
        "color_options": C.parse_hex(field(2), every(K.COLOR_CODES)),
    })
    in_range = F.col("partition_code").between(0, K.PARTITION_CODES - 1)
    wrong = F.when(F.size(fields) != 3, "three fields are needed").when(~F.coalesce(in_range, F.lit(False)), "bad partition code")
    wrong = wrong.when(F.coalesce(F.col("_lines"), F.lit(0)) <= 0, "bad set of line limits").when(~F.coalesce(F.col("color_options").between(1, (1 << K.COLOR_CODES) - 1), F.lit(False)), "bad set of colours")
    return rows.withColumn("_wrong", wrong)


def parse_variants(df: DataFrame, column: str = "variants") -> DataFrame:
    """`P:L:C,...` -> a row for each line limit of each part; a part that can't be read gives no row."""
    rows = variant_parts(df, column).where("_wrong IS NULL")
    return rows.select(*df.columns, "partition_code", "color_options", F.explode(C.bits_set(F.col("_lines"), K.LINE_LIMITS)).alias("line_limit")).select(*df.columns, "partition_code", "color_options", "line_limit")


def numbered_variants(df: DataFrame, column: str = "variants") -> DataFrame:
    """parse_variants() of a single row, with variant_id: numbers in the order of parts and line limits, so that
    two parts of one code and line limit are two variants."""
    line = F.explode(C.bits_set(F.col("_lines"), K.LINE_LIMITS)).alias("line_limit")
    rows = variant_parts(df, column).where("_wrong IS NULL").select("_at", "partition_code", "color_options", line)
    return rows.select((F.col("_at") * K.LINE_LIMITS + F.col("line_limit")).cast("int").alias("variant_id"), "partition_code", "line_limit", "color_options")


def pack_variants(df: DataFrame) -> DataFrame:
    """Adds `record`: 10 bytes, little-endian: code (2), line limit (1), colours (7)."""

    def little(value, count: int):
        digits = F.lpad(F.hex(value), 2 * count, "0")
        return F.concat(*[F.substring(digits, 2 * (count - i) - 1, 2) for i in range(count)])

    return df.withColumn("record", F.unhex(F.concat(little(F.col("partition_code"), 2), little(F.col("line_limit"), 1), little(F.col("color_options"), 7))))


def unpack_variants(df: DataFrame) -> DataFrame:
    """The reverse of pack_variants for a column `record`."""

    def little(begin: int, count: int):
        digits = F.hex("record")
        return F.conv(F.concat(*[F.substring(digits, 2 * (begin + i) + 1, 2) for i in reversed(range(count))]), 16, 10).cast("long")

    return df.withColumns({"partition_code": little(0, 2), "line_limit": little(2, 1), "color_options": little(3, 7)})

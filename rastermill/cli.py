"""Command line: encode and decode image files.

    python -m rastermill.cli [-jN] [-oFOLDER] [-tBYTES] [-pP:L:C,...] [-r] -e IMAGE ... -d STREAM ...

Arguments are taken in order: each file is handled as the options before it say, files that follow each
other under the same options in one job. -e codes the PNG files after it into FOLDER/NAME.rim, -d decodes the
streams after it into FOLDER/NAME.png, -r decodes what -e has coded at once. -t is the largest size of a
stream. -p names variants: partition code, set of line limits and set of colour codes in hexadecimal, * for
all of a set; `-p all` tries every variant with every colour code. -h shows this text. -j is the number of local cores where no cluster is set. Values may follow their option as an
argument of its own.
"""

from __future__ import annotations

import sys
from itertools import groupby
from typing import NamedTuple

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions import columns as C
from rastermill.functions import dimensions
from rastermill.operators.decode import decode_images
from rastermill.operators.encode import encode_images
from rastermill.sources import files

LEAST_TARGET, LARGEST_TARGET, DEFAULT_TARGET, MOST_JOBS = 16, 1 << 20, 287, 256


class Job(NamedTuple):
    encode: bool
    roundtrip: bool
    target: int
    params: str
    folder: str


class UsageError(ValueError):
    pass


class HelpWanted(Exception):
    pass


def parse(arguments: list[str]) -> tuple[list[tuple[Job, list[str]]], int]:
    """Runs of files with their options, and the number of local cores."""

    def number(text: str, low: int, high: int) -> int:
        if not text.isascii() or not text.isdigit() or not low <= int(text) <= high:
            raise UsageError(f"{text}: a number of {low}..{high} is needed")
        return int(text)

    job, jobs, found, rest = Job(False, False, DEFAULT_TARGET, "D7:40:1FFFF", "."), 1, [], list(arguments)
    while rest:
        word = rest.pop(0)
        if not word.startswith("-") or word == "-":
            found.append((job, word))
            continue
        option, value = word[:2], word[2:]
        if option in ("-t", "-p", "-o", "-j") and not value:
            if not rest:
                raise UsageError(f"{option}: a value is missing")
            value = rest.pop(0)
        if word == "-h":
            raise HelpWanted
        if option in ("-e", "-d") and not value:
            job = job._replace(encode=option == "-e")
        elif option == "-r" and not value:
            job = job._replace(roundtrip=True)
        elif option == "-t":
            job = job._replace(target=number(value, LEAST_TARGET, LARGEST_TARGET))
        elif option == "-p":
            job = job._replace(params=value)
        elif option == "-o":
            job = job._replace(folder=value)
        elif option == "-j":
            jobs = number(value, 1, MOST_JOBS)
        else:
            raise UsageError(f"{word}: no such option")
    return [(options, [path for _, path in run]) for options, run in groupby(found, key=lambda f: f[0])], jobs


def numbered(paths: DataFrame) -> DataFrame:
    return paths.withColumn("image_id", F.xxhash64("path"))


def variants_of(spark: SparkSession, params: str) -> DataFrame:
    if params == "all":
        return dimensions.all_variants(spark)
    text = spark.createDataFrame([(params,)], "variants string")
    wrong = dimensions.variant_parts(text).where("_wrong IS NOT NULL").select("_part", "_wrong").first()
    if wrong:
        raise UsageError(f"-p {wrong['_part']}: {wrong['_wrong']}")
    return dimensions.numbered_variants(text)


def run_encode(spark: SparkSession, job: Job, paths: list[str]) -> int:
    """The number of files that failed."""
    pixels = numbered(files.read_png(spark, *paths))
    coded = encode_images(pixels.select("image_id", "y", "x", "r", "g", "b"), variants_of(spark, job.params), job.target)
    named = coded.join(pixels.select("image_id", C.file_name(F.col("path")).alias("name")).distinct(), "image_id").cache()
    for row in named.select("name", "status", "variant_id", "color", "mse", F.octet_length("data").alias("size"), C.psnr(F.col("mse")).alias("psnr")).toLocalIterator():
        print(f"{row['name']}: {row['status']}, size={row['size']}, PSNR={row['psnr']}, variant={row['variant_id']}, color={row['color']}")
    done = named.where("status = 'ok'")
    failed = named.where("status <> 'ok'").count() + len(paths) - named.count()
    failed += files.write_files(spark, done.select("name", "data"), job.folder, ".rim").where("NOT written").count()
    return failed + (run_decode(spark, done.select("image_id", "name", "data"), job.folder) if job.roundtrip else 0)


def run_decode(spark: SparkSession, streams: DataFrame, folder: str) -> int:
    images = files.write_png(decode_images(streams)).join(streams.select("image_id", "name"), "image_id").cache()
    return streams.count() - images.count() + files.write_files(spark, images.select("name", "data"), folder, ".png").where("NOT written").count()


def main(arguments: list[str] | None = None) -> int:
    try:
        runs, jobs = parse(sys.argv[1:] if arguments is None else arguments)
        if not runs:
            raise UsageError("no file is named")
        builder = SparkSession.builder.appName("rastermill")
        if not SparkConf().contains("spark.master"):
            builder = builder.master(f"local[{jobs}]")
        spark, failed = builder.getOrCreate(), 0
        for job, paths in runs:
            if job.encode:
                failed += run_encode(spark, job, paths)
            else:
                streams = numbered(spark.read.format("binaryFile").load(paths).select("path", F.col("content").alias("data")))
                failed += run_decode(spark, streams.select("image_id", C.file_name(F.col("path")).alias("name"), "data"), job.folder)
        return int(failed > 0)
    except HelpWanted:
        print(__doc__)
        return 0
    except UsageError as error:
        print(f"{error}\n{__doc__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())

"""Coded streams as tables: their nodes, which leaf holds a pixel, and coding by column expressions alone."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from rastermill.functions import columns as C
from rastermill.functions.constants import SLOTS, STATE_BITS
from rastermill.operators import decode
from rastermill.operators.entropy import LEAST

BIN = 32


@udtf(returnType="node string, level int, angle int, line long, r int, g int, b int, pixels long")
class StreamNodes:
    """The nodes of one stream in the order in which it has them: inner ones with their level, angle and line, leaves with
    their colour. A stream that can't be read, or null, has none."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        if data is not None:
            yield from decode.nodes_of(bytes(data))


def stream_nodes(streams: DataFrame) -> DataFrame:
    """streams (image_id, data) -> (image_id, node, level, angle, line, r, g, b, pixels)."""
    spark = streams.sparkSession
    spark.udtf.register("rastermill_stream_nodes", StreamNodes)
    return spark.sql("SELECT s.image_id, n.* FROM {streams} s, LATERAL rastermill_stream_nodes(s.data) n", streams=streams)


def leaf_of_pixel(pixels: DataFrame, leaves: DataFrame) -> DataFrame:
    """Adds to pixels (image_id, y, x) the columns of the span (image_id, y, x0, x1, ...) that holds each.

    Spans are cut into bins of BIN columns, so that the range is an equality of bins first: a span stands in as many bins as
    it meets, a pixel in one."""
    bins = F.explode(F.sequence(C.div(F.col("x0"), BIN), C.div(F.col("x1") - 1, BIN))).alias("_bin")
    cut = leaves.where("x1 > x0").select("*", bins)
    dealt = pixels.withColumn("_bin", C.div(F.col("x"), BIN))
    return dealt.join(cut, ["image_id", "y", "_bin"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))).drop("_bin", "x0", "x1")


# The coder in column expressions. A number's slots among SLOTS begin at value * SLOTS / max; the state gives up its lowest bits until it
# lies below 2 * LEAST * width / SLOTS, and then takes the number in.


def narrowed(entry: Column) -> Column:
    """(first slot, slots, ceiling of the state)."""
    first, end = C.div(entry["value"] * SLOTS, entry["max"]), C.div((entry["value"] + 1) * SLOTS, entry["max"])
    return F.struct(first.alias("first"), (end - first).alias("width"), C.div(2 * LEAST * (end - first), F.lit(SLOTS)).alias("ceiling"), entry["max"].alias("max"))


def shifted(state: Column, bits: Column) -> Column:
    return F.call_function("shiftright", state, bits)


def bits_lost(state: Column, ceiling: Column) -> Column:
    """How many bits a state loses until it lies below a ceiling: as many as it is longer, or one more."""
    longer = F.length(F.bin(state)) - F.length(F.bin(ceiling))
    return F.when(state < ceiling, 0).otherwise(longer + (shifted(state, longer) >= ceiling).cast("int"))


def zero_bits(state: Column) -> Column:
    """The zeros at the low end of a state above 0."""
    return F.bit_count(state.bitwiseAND(-state) - 1)


def taken_in(state: Column, number: Column) -> Column:
    return C.div(state, number["width"]) * SLOTS + state % number["width"] + number["first"]


def quietest_starts(once: DataFrame) -> DataFrame:
    """once (_list, numbers, head) -> (_list, start): of the start states that are tried, the first that gives up most zeros before
    its first one. Each trial is a row, each number of the head a step of its columns."""
    steps = once.agg(F.max("head")).first()[0] or 0  # 32 at most, for the room of a head is 4.3e9
    start = F.explode(F.sequence(C.long(LEAST), C.long(2 * LEAST + 27), C.long(32))).alias("start")
    rows = once.select("_list", "numbers", "head", start).withColumns({"state": F.col("start"), "zeros": F.lit(0), "silent": F.lit(True)})
    for k in range(steps):
        number, live = F.get("numbers", F.lit(k)), F.col("head") > k
        rows = rows.withColumns({"lost": F.when(live, bits_lost(F.col("state"), number["ceiling"])).otherwise(0), "clear": zero_bits(F.col("state"))})
        rows = rows.select(
            "_list", "numbers", "head", "start", F.when(live, taken_in(shifted(F.col("state"), F.col("lost")), number)).otherwise(F.col("state")).alias("state"),
            (F.col("zeros") + F.when(F.col("silent"), F.least("lost", "clear")).otherwise(0)).alias("zeros"), (F.col("silent") & (F.col("clear") >= F.col("lost"))).alias("silent"),
        )
    best = rows.groupBy("_list").agg(F.max(F.struct("zeros", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("_list", (-F.col("best.start")).alias("start"))


def coded(numbers: Column, start: Column) -> Column:
    """The stream of numbers from the last to the first, as a binary: a fold of the state and of what it has given up."""
    # Values that are used twice are bound as the only element of a list: an expression would be computed again for each use.
    bound = lambda value, use: F.transform(F.array(value), use)[0]

    def put(acc: Column, number: Column) -> Column:
        def lose(lost: Column) -> Column:
            low = acc["state"] % F.call_function("shiftleft", C.long(1), lost)
            gone = F.when(lost > 0, F.lpad(F.bin(low), lost, F.lit("0"))).otherwise("")  # the highest first, as it stands in the stream
            return F.struct(taken_in(shifted(acc["state"], lost), number).alias("state"), F.concat(gone, acc["bits"]).alias("bits"))

        return bound(bits_lost(acc["state"], number["ceiling"]), lose)

    def packed(done: Column) -> Column:
        front = F.reverse(F.lpad(F.bin(done["state"] % LEAST), STATE_BITS, "0"))
        bits = F.rtrim(F.translate(F.concat(front, done["bits"]), "0", " "))
        whole = F.translate(F.rpad(bits, C.div(F.length(bits) + 7, 8).cast("int") * 8, F.lit(" ")), " ", "0")
        byte = lambda i: F.lpad(F.conv(F.reverse(F.substring(whole, i, F.lit(8))), 2, 16), 2, "0")
        digits = F.transform(F.sequence(F.lit(1), F.length(whole), F.lit(8)), byte)
        return F.when(F.length(whole) == 0, F.lit("").cast("binary")).otherwise(F.unhex(F.array_join(digits, "")))

    return bound(F.aggregate(numbers, F.struct(start.alias("state"), F.lit("").alias("bits")), put), packed)


def encode_native(streams: DataFrame, key: str) -> DataFrame:
    """(key, entries, data) of streams (key, entries): the coder of `entropy` without Python. Equal lists of entries, of which short
    ones have many, are coded once; an empty list has an empty stream."""
    named = streams.select(key, "entries", F.md5(F.to_json("entries").cast("binary")).alias("_list"))
    numbers = F.transform(F.reverse(F.filter("entries", lambda e: e["max"] > 1)), narrowed)
    ending = F.aggregate("numbers", F.struct(F.lit(4.3e9).alias("room"), F.lit(0).alias("n")), lambda acc, e: F.when(acc["room"] < 1, acc).otherwise(F.struct((acc["room"] / e["max"]).alias("room"), (acc["n"] + 1).alias("n"))), lambda acc: acc["n"])
    once = named.groupBy("_list").agg(F.first("entries").alias("entries")).select("_list", numbers.alias("numbers")).withColumn("head", ending)
    done = once.join(quietest_starts(once), "_list").select("_list", coded(F.col("numbers"), F.col("start")).alias("data"))
    return named.join(done, "_list").select(key, "entries", "data")

"""The format's scalar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastermill.functions import constants as K


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def long(x: int | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


# Parsing


def parse_int(text: Column) -> Column:
    """All digits of a text as one number; other characters are skipped; null without a digit."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(1, 18), digits.cast("long"))


def parse_hex(text: Column, wildcard: Column) -> Column:
    """A hexadecimal number of up to 16 digits as 64 bits (its sign is the highest), or `wildcard` for *; null
    for what can't be read."""
    digits = F.lpad(text, 16, "0")
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    value = F.call_function("shiftleft", half(1), F.lit(32)).bitwiseOR(half(9))
    return F.when(text == "*", wildcard).when(F.rlike(text, F.lit("^[0-9a-fA-F]{1,16}$")), value)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def single_bit(value: Column) -> Column:
    """The place of the only bit set."""
    return F.bit_count(value - 1)


def option_bits(options: Column) -> Column:
    """A list of options as a set of bits."""
    return F.aggregate(options, long(0), lambda acc, x: acc + F.call_function("shiftleft", long(1), x.cast("int")))


def bits_set(value: Column, count: int) -> Column:
    """The places of the bits set among the first `count`."""
    return F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.getbit(value, i) == 1)


# Partition and colour codes


def split_code(code: Column) -> list[Column]:
    """The four parts of a partition code."""
    return [code % K.F1, div(code, K.F1) % K.F2, div(code, K.F1 * K.F2) % K.F3, div(code, K.F1 * K.F2 * K.F3) % K.F4]


def join_code(f1: Column, f2: Column, f3: Column, f4: Column) -> Column:
    return f1 + K.F1 * (f2 + K.F2 * (f3 + K.F3 * f4))


def color_quant(code: Column) -> Column:
    """Steps of each channel for a code without a palette; 0 otherwise."""
    fine = 1 + F.call_function("shiftleft", (4 + code % 4).cast("int"), div(code, 4).cast("int"))
    return F.when(code < K.FIRST_PALETTE_CODE, long(fine)).otherwise(long(0))


def palette_size(code: Column) -> Column:
    return F.when(code < K.FIRST_PALETTE_CODE, long(0)).otherwise(long(code) - (K.FIRST_PALETTE_CODE - 1))


def dequantize(value: Column, quant: Column) -> Column:
    return div(255 * value, quant - 1)


def quantize(mean: Column, quant: Column) -> Column:
    return F.floor(mean * (quant - 1) / 255.0 + 0.5)


def level_scale(width: Column, height: Column, code: Column) -> Column:
    """Thresholds of squared size for the levels, in 32-bit arithmetic."""
    _, f2, f3, _ = split_code(code)
    divisor = F.element_at(F.array(*[long(d) for d in K.LEVEL_DIVISORS]), (f3 + 1).cast("int"))
    start = (long(width * width + height * height) * (f2 + 2) * (f2 + 2)).bitwiseAND(F.lit(K.U32))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(K.LEVELS)),
        F.struct(start.alias("scale"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, i: F.struct(div((acc["scale"] * K.LEVEL_STEP).bitwiseAND(F.lit(K.U32)), divisor).alias("scale"), F.concat(acc["out"], F.array(div(acc["scale"], K.LEVEL_BASE))).alias("out")),
    )
    return steps["out"]


def angle_bits(code: Column) -> Column:
    """Bits of an angle for each level."""
    f1, _, _, f4 = split_code(code)
    return F.transform(F.sequence(F.lit(0), F.lit(K.LEVELS - 1)), lambda i: F.greatest(long(0), 9 - f1 - i - div(i * f4, 2)))


def level_of(size: Column, scale: Column) -> Column:
    """The first level whose threshold a squared size reaches; the last if none."""
    at = F.array_position(F.transform(scale, lambda s: size >= s), F.lit(True))
    return F.when(at == 0, long(K.LEVELS - 1)).otherwise(at - 1)


# Sizes and costs


def log2floor(value: Column) -> Column:
    return F.length(F.bin(value)) - 1


def size_bits(value: Column) -> Column:
    return 3 + log2floor(value - 1)


def image_tax(width: Column, height: Column) -> Column:
    return F.lit(K.HEADER_BITS) + size_bits(width) + size_bits(height)


def psnr(mse: Column) -> Column:
    return F.when(mse > 0.01, 10 * F.log10(65025.0 / mse)).otherwise(F.lit(float("inf")))


# Check sums and generators


def crc64(data: Column) -> Column:
    """Of a list of bytes (0..255), as 16 upper-case digits."""

    def step(acc: Column, byte: Column) -> Column:
        def shift(x: Column, _: Column) -> Column:
            half = F.shiftrightunsigned(x, 1)
            return F.when(x.bitwiseAND(F.lit(1)) == 1, half.bitwiseXOR(F.lit(K.CRC64_POLYNOMIAL))).otherwise(half)

        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), acc.bitwiseXOR(long(byte)), shift)

    return F.lpad(F.hex(F.bitwise_not(F.aggregate(data, long(-1), step))), 16, "0")


def text_bytes(text: Column) -> Column:
    """A text's UTF-8 bytes as numbers."""
    data = text.cast("binary")
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))


def xorshift(state: Column) -> Column:
    """The next 32-bit state, shifts 13, 17, 5."""
    a = state.bitwiseXOR((state * (1 << 13)).bitwiseAND(F.lit(K.U32)))
    b = a.bitwiseXOR(F.shiftright(a, 17))
    return b.bitwiseXOR((b * (1 << 5)).bitwiseAND(F.lit(K.U32)))


def unit_number(state: Column) -> Column:
    return F.shiftright(state, 9) / 8388608.0


def lcg(state: Column) -> Column:
    return state * K.LCG_FACTOR % K.LCG_MODULUS

"""FNV-1a, CRC-32 and Adler-32 as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
SAMPLE = 8192  # fixed value: code units that the image key looks at


def code_units(text: Column) -> Column:
    """array<bigint>: UTF-16 code units; a character beyond the basic plane is two."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    high = lambda p: F.lit(0xD800) + F.shiftright(p - 0x10000, 10)
    low = lambda p: F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF).cast("bigint"))
    return F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(high(p), low(p)))))


def fnv1a(units: Column) -> Column:
    """32-bit FNV-1a over an array of code units."""
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193).cast("bigint")).bitwiseAND(F.lit(MASK).cast("bigint"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("bigint"), step)


def image_key(text: Column) -> Column:
    """The bucket of an image's data: FNV-1a of the first SAMPLE code units, a bar and the number of all, in hexadecimal; null for none."""
    length = (F.length(F.encode(text, "UTF-16BE")) / 2).cast("bigint").cast("string")
    units = F.slice(code_units(F.substring(text, 1, SAMPLE)), F.lit(1), F.lit(SAMPLE))
    return F.when(F.length(text) > 0, F.lower(F.hex(fnv1a(F.concat(units, code_units(F.concat(F.lit("|"), length)))))))


def byte_values(data: Column) -> Column:
    """array<bigint> of a binary."""
    pairs = F.filter(F.split(F.hex(data), r"(?<=\G..)"), lambda h: h != "")
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("bigint"))


def adler32(data: Column) -> Column:
    zero = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    step = lambda s, v: F.struct(((s["a"] + v) % 65521).alias("a"), ((s["b"] + s["a"] + v) % 65521).alias("b"))
    return F.aggregate(byte_values(data), zero, step, lambda s: s["b"] * 65536 + s["a"])


def crc32(data: Column) -> Column:
    return F.crc32(data)
